"""The whole way of a message into the ledger, put together from the operators."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywell.fixed_values import PARSE_LIMIT_REACHED
from tallywell.operators import dedup, parse, posting, resolve, rules, transfers, usage
from tallywell.plans.skew import is_small
from tallywell.session import materialise


@dataclass
class Ingested:
    """What one ingest run produced. Each result is made when it is first asked for, so a reader of one pays for no other."""

    shaped: DataFrame
    resolved: DataFrame
    categories: DataFrame
    book: rules.RuleBook
    history: DataFrame | None

    @cached_property
    def legs(self) -> DataFrame:
        return split(self.resolved, self.categories, self.book)

    @cached_property
    def posted(self) -> DataFrame:
        """Ledger rows, written once: duplicate lookups and the flagged result read them."""
        return materialise(ruled(self.legs, self.book), "posted")

    @cached_property
    def broken(self) -> DataFrame:
        """The messages that rules leave without an account; a pair whose rule names no destination is refused as a whole.

        A rule takes no account away, so only legs without one can end without one.
        """
        posted = self.__dict__.get("posted")
        rows = ruled(self.legs.filter(F.col("account_id").isNull()), self.book) if posted is None else posted
        broken = materialise(rows.filter(F.col("account_id").isNull()).select("message_id").distinct(), "broken")
        return F.broadcast(broken) if is_small(broken) else broken

    @cached_property
    def ledger(self) -> DataFrame:
        sound = self.posted.join(self.broken, "message_id", "left_anti")
        columns = ["id", "message_id", "user_id", "source", "raw_text", "date", "amount", "account_id",
                   "created_at", "deleted_at"]
        stored = sound.select(*columns)
        if self.history is not None:
            stored = stored.unionByName(self.history.select(*columns))
        checked = dedup.flag_duplicates(
            sound.filter(F.col("channel") == "api"), stored, "parsed_account_id"
        )
        unchecked = sound.filter(F.col("channel") != "api")
        return unchecked.unionByName(checked, allowMissingColumns=True)

    @cached_property
    def skipped(self) -> DataFrame:
        return parse.skipped(self.resolved, "parsed_bank")

    @cached_property
    def rejects(self) -> DataFrame:
        refused = self.resolved.filter(F.col("reject").isNotNull()).select(
            "message_id", "channel", "user_id", F.col("reject").alias("reason")
        )
        unpaired = (
            self.legs.join(self.broken, "message_id", "left_semi")
            .filter(F.col("leg") == 0)
            .select("message_id", "channel", "user_id", F.lit("No destination account").alias("reason"))
        )
        unread = self.shaped.filter(F.col("problem").isNotNull()).select(
            "message_id", "channel", "user_id", F.col("problem").alias("reason")
        )
        return refused.unionByName(unpaired).unionByName(unread)

    @cached_property
    def refused_rules(self) -> DataFrame:
        return rules.refused_rules(self.book)


def resolve_messages(shaped: DataFrame, accounts: DataFrame, categories: DataFrame, rule_table: DataFrame | rules.RuleBook) -> DataFrame:
    """Shaped messages to parsed, dated rows with account and category; ``reject`` says why not.

    Skipped messages ride along with ``is_transaction`` false and no reject reason. The parsed
    rows are written down: they are the costly part, and every reader of the result starts from them.
    """
    detected = rules.detect_accounts(shaped.filter(F.col("problem").isNull()), rule_table)
    dated = parse.with_event_time(parse.parse_messages(detected))
    is_email = F.col("channel") == "email"
    dated = dated.withColumns(
        {
            "parsed_bank": F.col("bank"),
            "bank": F.when(is_email, "bancolombia").otherwise(F.col("bank")),
            "source": F.coalesce("source", "parsed_source"),
        }
    )
    dated = materialise(dated, "parsed")
    accounted = resolve.with_fallback(resolve.resolve_accounts(dated, accounts, written=True), accounts)
    known = resolve.resolve_categories(accounted, categories)
    reason = parse.reject_reason(
        F.col("amount"), F.col("description"), F.col("category"), F.col("is_transaction")
    )
    late = F.when(
        F.col("is_transaction"),
        F.when(F.col("date").isNull(), "Invalid date").when(F.col("account_id").isNull(), "No account"),
    )
    return known.withColumn("reject", F.coalesce(reason, late)).drop("cascade_account_id")


def split(resolved: DataFrame, categories: DataFrame, rule_table: DataFrame | rules.RuleBook) -> DataFrame:
    """Resolved transactions to ledger rows as they are before rules: transfers split."""
    none = F.lit(None).cast("string")
    rows = resolved.filter(F.col("is_transaction") & F.col("reject").isNull()).withColumns(
        {
            "type": F.lit("expense"),
            "notes": none,
            "raw_text": F.col("text"),
            "created_at": F.col("received_at"),
            "parsed_account_id": F.col("account_id"),
            "payment_method": F.col("payment_type"),
            "parsed_data": parse.stored_record("parsed_bank"),
        }
    )
    return transfers.split_transfers(rows, rule_table, categories)


def ruled(legs: DataFrame, rule_table: DataFrame | rules.RuleBook) -> DataFrame:
    return rules.apply_rules(legs, rule_table).withColumn("deleted_at", F.lit(None).cast("timestamp_ntz"))


def ingest(
    shaped: DataFrame, accounts: DataFrame, categories: DataFrame, rule_table: DataFrame,
    history: DataFrame | None = None,
) -> Ingested:
    """The full path. Parsed rows and ledger rows are written once to the shared folder.

    Both feed several branches (ledger, skipped, rejects; duplicate lookups and the flagged
    result), so a written table costs less than computing them again and outlives an
    executor. Rules are judged and parsed once. Duplicates are looked for in the API channel only, against ``history`` and
    the run's own earlier rows.
    """
    book = rules.rule_book(rule_table, keep=True)
    resolved = resolve_messages(shaped, accounts, categories, book)
    return Ingested(shaped, resolved, categories, book, history)


@dataclass
class Previewed:
    """What one run of parse-only requests produced. Each result is made when it is first asked for: who was denied needs no parse."""

    decided: DataFrame
    accounts: DataFrame
    categories: DataFrame
    rule_table: DataFrame

    @cached_property
    def parsed(self) -> DataFrame:
        detected = rules.detect_accounts(self.decided.filter("allowed"), self.rule_table)
        return parse.with_preview_time(parse.parse_messages(detected.withColumn("channel", F.lit("parse"))))

    @cached_property
    def previews(self) -> DataFrame:
        wanted = parse.transactions_only(self.parsed)
        placed = resolve.with_fallback(resolve.resolve_accounts(wanted, self.accounts), self.accounts)
        known = resolve.resolve_categories(placed, self.categories)
        fields = ["amount", "description", "category", "bank", "payment_type", "confidence",
                  "original_date", "original_time", "last_four", "account_type", "is_transaction"]
        return known.select(
            "message_id",
            "user_id",
            F.struct(*fields, F.col("parsed_source").alias("source")).alias("parsed"),
            F.struct("account_id", "category_id").alias("resolved"),
        )

    @cached_property
    def skipped(self) -> DataFrame:
        return parse.skipped(self.parsed)

    @cached_property
    def denied(self) -> DataFrame:
        return self.decided.filter("NOT allowed").select(
            "message_id", "user_id", "used", "limit", F.lit(PARSE_LIMIT_REACHED).alias("reason")
        )


def preview(
    requests: DataFrame, accounts: DataFrame, categories: DataFrame, rule_table: DataFrame,
    stored_usage: DataFrame, subscriptions: DataFrame, settings: DataFrame,
) -> Previewed:
    """Parse-only requests: quota first, then the parse, nothing posted.

    A request over its owner's monthly limit is denied before its text is looked at; skipped
    messages have used up their admission. Previews are nested: ``parsed`` and ``resolved``.
    """
    asked = requests.withColumn("request_id", F.col("message_id"))
    decided = materialise(
        usage.quota_admission(asked, stored_usage, subscriptions, settings), "decided"
    )
    return Previewed(decided, accounts, categories, rule_table)


def month_closing(ledger: DataFrame, accounts: DataFrame) -> DataFrame:
    """Per account and month: income, expense, net and the closing balance.

    The effects are summed to one row per account and month before anything is ordered, so
    the running window sees at most one row per month of an account's life.
    """
    zero = F.lit(0).cast("decimal(15,2)")
    delta = F.col("delta")
    months = (
        posting.balance_effects(ledger)
        .groupBy(
            F.col("effect_account_id").alias("account_id"),
            F.date_format("date", "yyyy-MM").alias("month"),
        )
        .agg(
            F.sum(F.when(delta > 0, delta).otherwise(zero)).cast(posting.TOTAL).alias("money_in"),
            F.sum(F.when(delta < 0, -delta).otherwise(zero)).cast(posting.TOTAL).alias("money_out"),
            F.sum(delta).cast(posting.TOTAL).alias("net"),
        )
    )
    so_far = Window.partitionBy("account_id").orderBy("month").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    opening = accounts.select("account_id", F.coalesce("balance", zero).alias("opening"))
    return (
        months.withColumn("moved", F.sum("net").over(so_far))
        .join(opening, "account_id", "left")
        .select(
            "account_id", "month", "money_in", "money_out", "net",
            (F.coalesce("opening", zero) + F.col("moved")).cast(posting.TOTAL).alias("closing_balance"),
        )
    )
