"""Messages to parsed expenses, and the check of parsed records from elsewhere."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywell import fixed_values as fv
from tallywell.functions import eventtime, parse, transfer
from tallywell.functions.text import fold, wide_trim
from tallywell.plans.once import once
from tallywell.schemas import PARSED_EXPENSE

MONEY = "decimal(15,2)"


#: What each parsed field is made from; the others are made from the text alone.
MADE_FROM = {
    "category": ["description"],
    "description": ["is_transaction", "parsed_source", "phone"],
    "amount": ["is_transaction", "_digits", "_in_thousands"],
    "_digits": ["_signed", "_suffixed"],
    "_in_thousands": ["_signed", "_signed_suffix", "_suffixed"],
    "confidence": ["skip_reason", "original_date", "parsed_source"],
    "is_transaction": ["skip_reason"],
    "skip_reason": ["_skip_phrase"],
    "bank": ["parsed_source"],
    "payment_type": ["parsed_source"],
    "original_date": ["_explicit", "_named_day", "_named_month", "_named_year", "_weekday", "_month_day", "_today", "_days_ago", "_this_period"],
    "_explicit": ["_slashed", "_dashed"],
    "_named_day": ["_named"],
    "_named_month": ["_named"],
    "_named_year": ["_named"],
    "_weekday": ["_spoken_weekday", "_last_monday"],
    "_month_day": ["_spoken_day"],
    "_today": ["_named", "_spoken_weekday", "_spoken_day", "_days_ago", "_last_monday", "_this_period"],
    "original_time": ["_hour", "_minutes", "_half"],
    "_hour": ["_clock", "_clock_half", "_clock_part"],
    "_minutes": ["_clock"],
    "_half": ["_clock", "_clock_half", "_clock_part"],
}


def _with_parts(fields: Collection[str]) -> set[str]:
    """The fields and all that they are made from."""
    found, queue = set(), list(fields)
    while queue:
        name = queue.pop()
        if name not in found:
            found.add(name)
            queue += MADE_FROM.get(name, [])
    return found


def parse_messages(messages: DataFrame, only: Collection[str] | None = None) -> DataFrame:
    """Add the parsed fields to messages with ``text`` and ``received_at``.

    A message that is no transaction keeps its bank fields and gets amount 0, an empty
    description and category 'missing'. The parsed source is ``parsed_source``; ``source``
    stays the channel's. ``only`` names the fields that are wanted, for readers that need few:
    the others are neither worked out nor added.
    """
    text, folded = F.col("text"), F.col("_folded")
    source, is_transaction = F.col("parsed_source"), F.col("skip_reason").isNull()
    # One step per layer: each result is computed once and read by the next layer.
    found = {
        "parsed_source": parse.source(text),
        "_skip_phrase": parse.skip_phrase(folded),
        **parse.amount_captures(text, folded),
        **parse.date_captures(folded),
        **parse.time_captures(folded),
    }
    parts = {**parse.amount_digits(folded), **parse.date_parts(F.col("received_at")), **parse.time_parts()}
    fields = {
        "skip_reason": parse.skip_reason(folded, F.col("_skip_phrase")),
        "original_date": parse.original_date(),
        "original_time": parse.original_time(folded),
        "phone": transfer.phone(text),
        "origin_account": transfer.origin_account(text),
        "is_transfer": transfer.is_transfer(text),
        "bank": parse.bank(folded, source),
        "payment_type": parse.payment_type(folded, source),
        "last_four": parse.last_four(text),
        "account_type": parse.account_type(folded),
    }
    described = {
        "is_transaction": is_transaction,
        "amount": F.when(is_transaction, parse.amount()).otherwise(F.lit(0).cast(MONEY)),
        "description": F.when(
            is_transaction, parse.description(text, source, F.col("phone"))
        ).otherwise(""),
        "confidence": parse.confidence(
            folded, source, F.col("skip_reason"), F.col("original_date")
        ),
    }
    sorted_out = {"category": parse.category(fold(F.col("description")))}

    parsed = ["parsed_source", *fields, *described, *sorted_out]
    wanted = set(parsed if only is None else only)
    if unknown := wanted - set(parsed):
        raise ValueError(f"no parsed fields: {sorted(unknown)}")
    needed = _with_parts(wanted)
    found, parts, fields, described, sorted_out = (
        {name: column for name, column in layer.items() if name in needed}
        for layer in (found, parts, fields, described, sorted_out)
    )
    helpers = ["_folded", *parts, *[name for name in found if name != "parsed_source"]]
    rows = messages.withColumn("_folded", fold(text)).withColumns(found).withColumns(parts)
    for layer in (fields, described):
        rows = once(rows, layer) if layer else rows
    rows = rows.drop(*helpers)
    rows = once(rows, sorted_out) if sorted_out else rows
    return rows.drop(*[name for name in parsed if name not in wanted])


def transactions_only(parsed: DataFrame) -> DataFrame:
    """Only an explicit false skips; NULL counts as a transaction."""
    return parsed.filter(~F.col("is_transaction").eqNullSafe(F.lit(False)))


#: The parsed record as it is stored beside a ledger row or a skipped message.
RECORD = ["amount", "description", "category", "bank", "payment_type", "source", "confidence", "original_date",
          "original_time", "last_four", "account_type", "is_transaction", "skip_reason"]


def stored_record(bank: str = "bank") -> Column:
    """The whole parsed record as JSON; ``bank`` and source as the text told them."""
    told = {"bank": bank, "source": "parsed_source"}
    return F.to_json(F.struct(*[F.col(told.get(name, name)).alias(name) for name in RECORD]))


def skipped(parsed: DataFrame, bank: str = "bank") -> DataFrame:
    """The skipped-message audit rows: reason, where the message came from, and the whole record."""
    origin = F.when(F.col("channel") == "chat", fv.CHAT_SOURCE).when(F.col("channel") == "parse", "api")
    return parsed.filter(F.col("is_transaction").eqNullSafe(F.lit(False))).withColumns(
        {
            "reason": F.coalesce(F.nullif(F.col("skip_reason"), F.lit("")), F.lit(fv.DEFAULT_SKIP_REASON)),
            "parsed_data": stored_record(bank),
            "source": F.coalesce(origin, F.col("source")),
        }
    )


def strip_fence(document: Column) -> Column:
    """JSON text without the markdown fence a model may put around it."""
    return wide_trim(F.regexp_replace(document, r"```json\n?|\n?```", ""))


def read_parsed_json(df: DataFrame, column: str) -> DataFrame:
    """Parsed-expense columns from a column of JSON text; ``bad_json`` marks what is none."""
    clean = strip_fence(F.col(column))
    record = F.from_json(clean, PARSED_EXPENSE, {"mode": "PERMISSIVE"})
    is_object = F.try_parse_json(clean).isNotNull() & F.startswith(clean, F.lit("{"))
    return df.withColumn("_record", record).select(
        *df.columns, "_record.*", (~F.coalesce(is_object, F.lit(False))).alias("bad_json")
    )


def reject_reason(amount: Column, description: Column, category: Column, is_transaction: Column) -> Column:
    """Why a parsed record is refused, in the order of the checks; NULL where it is fine."""
    blank = F.coalesce(wide_trim(description), F.lit("")) == ""
    return F.when(
        ~is_transaction.eqNullSafe(F.lit(False)),
        F.when(F.coalesce(amount, F.lit(0)) <= 0, fv.REJECT_AMOUNT)
        .when(blank, fv.REJECT_DESCRIPTION)
        .when(F.coalesce(category, F.lit("")) == "", fv.REJECT_CATEGORY),
    )


def validate_parsed(parsed: DataFrame) -> DataFrame:
    """Add ``reject_reason``; a NULL ``is_transaction`` becomes true."""
    reason = reject_reason(
        F.col("amount"), F.col("description"), F.col("category"), F.col("is_transaction")
    )
    return parsed.withColumns(
        {
            "reject_reason": reason,
            "is_transaction": F.coalesce(F.col("is_transaction"), F.lit(True)),
        }
    )


def with_event_time(parsed: DataFrame) -> DataFrame:
    """Add ledger ``date`` and ``time``; ``date`` is NULL where the stated day does not exist."""
    trimmed = once(
        parsed, {"_date": wide_trim(F.col("original_date")), "_time": wide_trim(F.col("original_time"))}
    )
    fixed = once(
        trimmed,
        {
            "_date": eventtime.fix_trimmed_date(F.col("_date")),
            "_time": eventtime.fix_trimmed_time(F.col("_time")),
        },
    )
    date, time, arrival = F.col("_date"), F.col("_time"), F.col("received_at")
    chosen = {
        "date": eventtime.choose_date(date, arrival),
        "time": eventtime.choose_time(date, time, arrival),
    }
    return once(fixed, chosen).drop("_date", "_time")


def with_preview_time(parsed: DataFrame) -> DataFrame:
    """The preview keeps what was stated when it cannot be fixed."""
    return parsed.withColumns(
        {
            "original_date": F.coalesce(
                eventtime.fix_date(F.col("original_date")), F.col("original_date")
            ),
            "original_time": F.coalesce(
                eventtime.fix_time(F.col("original_time")), F.col("original_time")
            ),
        }
    )
