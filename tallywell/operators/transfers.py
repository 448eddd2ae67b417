"""Internal transfers: one message becomes a pair of ledger legs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywell import fixed_values as fv
from tallywell.functions import transfer
from tallywell.operators.resolve import named_category
from tallywell.operators.rules import RuleBook, phone_rules, rule_book
from tallywell.plans.skew import is_small, lookup


def phone_rule_lookup(rules: DataFrame) -> DataFrame:
    """One rule per (user, phone): highest priority first, then rule id."""
    first = F.min_by(
        F.struct("rule_id", "name", "transfer_to_account_id"),
        F.struct(-F.col("priority"), F.col("rule_id")),
    )
    return (
        phone_rules(rules)
        .groupBy("user_id", F.col("match_phone").alias("phone"))
        .agg(first.alias("rule"))
        .select(
            "user_id",
            "phone",
            F.col("rule.rule_id").alias("transfer_rule_id"),
            F.col("rule.name").alias("transfer_rule_name"),
            F.col("rule.transfer_to_account_id").alias("rule_account_id"),
        )
    )


def _noted(notes: Column, line: Column) -> Column:
    empty = F.coalesce(notes, F.lit("")) == ""
    return F.when(empty, line).otherwise(F.concat(notes, F.lit("\n"), line))


def split_transfers(
    transactions: DataFrame, rules: DataFrame | RuleBook, categories: DataFrame
) -> DataFrame:
    """One ledger row per message, or two legs where a phone rule names the other account.

    Expects message_id, user_id, text, phone, origin_account, is_transfer, category,
    category_id, account_id, description, type and notes. Adds ``leg``, ``id``,
    ``transfer_to_account_id``, ``transfer_id`` and the rule's name. Only the outgoing leg
    names the other account, so balances move once.
    """
    book = rule_book(rules)
    user_categories = named_category(categories, "missing", "missing_category_id").join(
        named_category(categories, "transfer", "transfer_category_id"), "user_id", "full"
    )
    joined = lookup(
        transactions.withColumn("phone", transfer.plain_phone(F.col("phone"))),
        phone_rule_lookup(book.table),
        ["user_id", "phone"],
        known_small=book.small,
        costly=True,
    )
    joined = lookup(joined, user_categories, ["user_id"], known_small=is_small(categories), costly=True)

    is_transfer = F.col("is_transfer") | (F.col("category") == "transfer")
    matched = F.col("transfer_rule_id").isNotNull()
    phone, notes, missing = F.col("phone"), F.col("notes"), F.col("missing_category_id")
    pair_category = F.coalesce(F.col("transfer_category_id"), missing)
    pair_id = F.sha2(F.concat_ws("|", F.lit("transfer"), F.col("message_id")), 256)
    none = F.lit(None).cast("string")

    def leg(number: int, kind, category, account, other, pair, text, note) -> Column:
        return F.struct(
            F.lit(number).alias("leg"),
            kind.cast("string").alias("type"),
            category.cast("string").alias("category_id"),
            account.cast("string").alias("account_id"),
            other.cast("string").alias("transfer_to_account_id"),
            pair.cast("string").alias("transfer_id"),
            text.cast("string").alias("description"),
            note.cast("string").alias("notes"),
        )

    expense, account, text = F.lit("expense"), F.col("account_id"), F.col("description")
    as_is = leg(0, F.col("type"), F.col("category_id"), account, none, none, text, notes)
    no_phone = leg(
        0, expense, missing, account, none, none, text,
        _noted(notes, F.lit(fv.NOTE_NO_PHONE)),
    )
    no_rule = leg(
        0, expense, missing, account, none, none, text,
        _noted(notes, F.concat(F.lit(fv.NOTE_NO_RULE[0]), phone, F.lit(fv.NOTE_NO_RULE[1]))),
    )
    outgoing = leg(
        0, F.lit("transfer"), pair_category, account, F.col("rule_account_id"), pair_id,
        F.concat(F.lit(fv.TEXT_OUTGOING), F.col("transfer_rule_name")),
        _noted(notes, F.concat(F.lit(fv.NOTE_OUTGOING), phone)),
    )
    named = F.coalesce(F.nullif(text, F.lit("")), F.lit(fv.INCOMING_FROM_UNNAMED))
    incoming = leg(
        1, F.lit("transfer"), pair_category, F.col("rule_account_id"), none, pair_id,
        F.concat(F.lit(fv.TEXT_INCOMING), named),
        F.concat(
            F.lit(fv.NOTE_INCOMING),
            F.coalesce(F.col("origin_account"), F.lit("unknown")),
        ),
    )
    legs = (
        F.when(~is_transfer, F.array(as_is))
        .when(phone.isNull(), F.array(no_phone))
        .when(~matched, F.array(no_rule))
        .otherwise(F.array(outgoing, incoming))
    )
    replaced = {"type", "category_id", "account_id", "description", "notes"}
    kept = [c for c in transactions.columns if c not in replaced]
    return (
        joined.withColumn("_leg", F.explode(legs))
        .select(*kept, "transfer_rule_name", "_leg.*")
        .withColumn("id", F.concat_ws("-", "message_id", "leg"))
    )


def transfer_pairs(ledger: DataFrame) -> DataFrame:
    """Both legs of each transfer side by side, by one pre-aggregated pass over the ledger."""
    outgoing = F.col("transfer_to_account_id").isNotNull()

    def of(side: Column, column: str) -> Column:
        return F.max(F.when(side, F.col(column)))

    return (
        ledger.filter(F.col("transfer_id").isNotNull())
        .groupBy("transfer_id")
        .agg(
            F.count(F.lit(1)).alias("legs"),
            of(outgoing, "id").alias("outgoing_id"),
            of(~outgoing, "id").alias("incoming_id"),
            of(outgoing, "account_id").alias("from_account_id"),
            of(outgoing, "transfer_to_account_id").alias("to_account_id"),
            F.max("amount").alias("amount"),
        )
    )
