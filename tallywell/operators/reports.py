"""Ledger reports: overview, month, categories, recent rows, pages, rule audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywell.functions import present
from tallywell.operators.resolve import live, not_deleted
from tallywell.plans.skew import first_rows, lookup

TOTAL = "decimal(38,2)"


def _sum_where(condition: Column, out: str) -> Column:
    zero = F.lit(0).cast("decimal(15,2)")
    return F.sum(F.when(condition, F.col("amount")).otherwise(zero)).cast(TOTAL).alias(out)


def net_worth(accounts: DataFrame) -> DataFrame:
    """Total balance and number of live accounts per user."""
    return live(accounts).groupBy("user_id").agg(
        F.sum(F.coalesce("balance", F.lit(0).cast("decimal(15,2)"))).cast(TOTAL).alias("net_worth"),
        F.count(F.lit(1)).alias("accounts"),
    )


def month_summary(ledger: DataFrame) -> DataFrame:
    """Income, expense and their difference per user and ledger month."""
    summed = (
        not_deleted(ledger)
        .groupBy("user_id", F.date_format("date", "yyyy-MM").alias("month"))
        .agg(
            _sum_where(F.col("type") == "income", "income"),
            _sum_where(F.col("type") == "expense", "expense"),
            F.count(F.lit(1)).alias("transactions"),
        )
    )
    return summed.withColumn("balance", (F.col("income") - F.col("expense")).cast(TOTAL))


def spending_by_category(ledger: DataFrame, categories: DataFrame) -> DataFrame:
    """Expense per user and category. Sums come first; names join the few result rows."""
    summed = (
        not_deleted(ledger)
        .filter(F.col("type") == "expense")
        .groupBy("user_id", "category_id")
        .agg(F.sum("amount").cast(TOTAL).alias("spent"), F.count(F.lit(1)).alias("transactions"))
    )
    return lookup(summed, categories.select("category_id", "name", "slug"), ["category_id"])


def category_counts(ledger: DataFrame, categories: DataFrame) -> DataFrame:
    """Transactions per category, zeros included."""
    counted = not_deleted(ledger).groupBy("category_id").agg(F.count(F.lit(1)).alias("n"))
    return lookup(categories.select("category_id", "name"), counted, ["category_id"]).select(
        "category_id", "name", F.coalesce("n", F.lit(0).cast("bigint")).alias("transactions")
    )


def recent(ledger: DataFrame, k: int = 10) -> DataFrame:
    """The k latest rows per user, newest first by date, time and id."""
    return first_rows(
        not_deleted(ledger), ["user_id"], [F.desc("date"), F.desc("time"), F.asc("id")], k
    )


def top_categories(ledger: DataFrame, categories: DataFrame, k: int = 5) -> DataFrame:
    """The k categories each user spends most on."""
    spent = spending_by_category(ledger, categories)
    return first_rows(spent, ["user_id"], [F.desc("spent"), F.asc("category_id")], k)


def search(
    ledger: DataFrame,
    types: list[str] | None = None,
    account_id: str | None = None,
    category_id: str | None = None,
    since: Column | None = None,
    until: Column | None = None,
    text: str | None = None,
) -> DataFrame:
    """Live rows under any mix of filters; plain comparisons reach the scan."""
    out = not_deleted(ledger)
    if types:
        out = out.filter(F.col("type").isin(*types))
    if account_id is not None:
        out = out.filter(F.col("account_id") == account_id)
    if category_id is not None:
        out = out.filter(F.col("category_id") == category_id)
    if since is not None:
        out = out.filter(F.col("date") >= since)
    if until is not None:
        out = out.filter(F.col("date") <= until)
    if text:
        out = out.filter(F.contains(F.lower("description"), F.lit(text.lower())))
    return out


PERIODS = ["this_month", "last_month", "this_year", "last_30_days"]


def period(name: str, today: Column) -> tuple[Column, Column]:
    """(since, until) of a period preset relative to a day."""
    month = F.trunc(today, "month")
    return {
        "this_month": (month, F.last_day(today)),
        "last_month": (F.add_months(month, -1), F.date_sub(month, 1)),
        "this_year": (F.trunc(today, "year"), F.last_day(F.add_months(F.trunc(today, "year"), 11))),
        "last_30_days": (F.date_sub(today, 30), today),
    }[name]


def page(ledger: DataFrame, size: int, after: tuple | None = None) -> DataFrame:
    """One page, newest first, after the (date, id) the last page ended with.

    A key filter plus a bounded sort: no page pays for the ones before it.
    """
    out = not_deleted(ledger)
    if after is not None:
        day, last_id = F.lit(after[0]).cast("date"), F.lit(after[1])
        out = out.filter(
            (F.col("date") < day) | ((F.col("date") == day) & (F.col("id") > last_id))
        )
    return out.orderBy(F.desc("date"), F.asc("id")).limit(size)


def rules_by_kind(rules: DataFrame, rule_type: str | None = None, active: bool | None = None) -> DataFrame:
    """Rule listing under the type and visibility filters."""
    out = rules.filter(F.col("deleted_at").isNull())
    if rule_type is not None:
        out = out.filter(F.col("rule_type") == rule_type)
    if active is not None:
        out = out.filter(F.col("is_active") == F.lit(active))
    return out


def categories_by_visibility(categories: DataFrame, active: bool) -> DataFrame:
    """Category listing under the visibility filter, by name."""
    kept = categories.filter(F.col("deleted_at").isNull() & (F.col("is_active") == F.lit(active)))
    return kept.orderBy("name", "category_id")


def applied_rule_audit(ledger: DataFrame) -> DataFrame:
    """How often each rule fired."""
    return (
        ledger.select("user_id", F.explode("applied_rules").alias("applied"))
        .groupBy(F.col("applied.rule_id").alias("rule_id"), F.col("applied.rule_name").alias("rule_name"))
        .agg(F.count(F.lit(1)).alias("times"))
    )


def confirmations(ledger: DataFrame, accounts: DataFrame) -> DataFrame:
    """The reply each posted row gets, with the account's balance.

    Expects account_id, amount, description, date, time, category, bank, payment_type,
    phone and transfer_rule_name (set on internal transfers only).
    """
    balances = accounts.select(
        "account_id", F.coalesce("balance", F.lit(0).cast("decimal(15,2)")).alias("balance")
    )
    day = F.date_format("date", "dd/MM/yyyy")
    head = F.concat_ws("\n", present.pesos(F.col("amount")), "description", F.concat_ws(" ", day, "time"))
    shown = F.concat(F.lit("Balance: "), present.pesos(F.coalesce("balance", F.lit(0).cast("decimal(15,2)"))))
    expense = F.concat_ws(
        "\n", F.lit("Expense registered"), head, "category",
        F.concat_ws(" - ", "bank", "payment_type"), shown,
    )
    moved = F.concat_ws(
        "\n", F.lit("Internal Transfer"), present.pesos(F.col("amount")), "transfer_rule_name",
        F.concat(F.lit("To: "), "phone"), F.concat_ws(" ", day, "time"), shown,
    )
    return lookup(ledger, balances, ["account_id"]).withColumn(
        "confirmation", F.when(F.col("transfer_rule_name").isNotNull(), moved).otherwise(expense)
    )
