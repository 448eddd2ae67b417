"""CSV statements to ledger rows, with rejects and the import audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywell.fixed_values import STATEMENT_CATEGORIES
from tallywell.functions.present import capitalise_first
from tallywell.functions.text import group1
from tallywell.operators.resolve import resolve_accounts, resolve_categories

MONEY = "decimal(15,2)"
STATEMENT_COLUMNS = ["Date", "Amount", "Category", "Account", "Note", "Labels"]
# ISO days and wall-clock times, then the month-first form statement exports use
DATE_FORMATS = ["yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm[:ss][.SSS]", "yyyy-MM-dd HH:mm[:ss]", "M/d/yyyy"]
ZONED = r"T.*(?:Z|[+-]\d{2}:?\d{2})$"


def statement_amount(text: Column) -> Column:
    """The leading number of the text without its sign."""
    return F.abs(group1(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+))").try_cast(MONEY))


def statement_date(text: Column) -> Column:
    """The UTC calendar day of the stated moment; a time without a zone is taken as UTC."""
    clean = F.trim(text)
    instant = F.to_utc_timestamp(F.try_to_timestamp(clean), F.current_timezone())
    wall_clock = F.coalesce(*[F.try_to_date(clean, f) for f in DATE_FORMATS])
    return F.when(clean.rlike(ZONED), F.to_date(instant)).otherwise(wall_clock)


def statement_category(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in STATEMENT_CATEGORIES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, name), F.lit("other"))


def statement_institution(name: Column) -> Column:
    lowered = F.lower(F.coalesce(name, F.lit("")))
    return (
        F.when(F.contains(lowered, F.lit("bancolombia")), "bancolombia")
        .when(F.contains(lowered, F.lit("nequi")), "nequi")
        .when(F.contains(lowered, F.lit("cash")) | F.contains(lowered, F.lit("efectivo")), "cash")
        .otherwise("bancolombia")
    )


def statement_description(note: Column, category: Column, labels: Column) -> Column:
    text = F.coalesce(F.nullif(note, F.lit("")), category, F.lit(""))
    tagged = F.when(
        F.coalesce(labels, F.lit("")) != "", F.concat(text, F.lit(" ("), labels, F.lit(")"))
    ).otherwise(text)
    return capitalise_first(tagged)


def import_statement(rows: DataFrame, accounts: DataFrame, categories: DataFrame) -> DataFrame:
    """Ledger rows from statement rows (import_id, row_id, user_id and the six columns).

    A row that cannot be posted keeps its place with ``reasons`` filled; the others go on.
    """
    corrupt = F.col("_corrupt").isNotNull() if "_corrupt" in rows.columns else F.lit(False)
    read = rows.select(
        "import_id",
        "row_id",
        "user_id",
        statement_date(F.col("Date")).alias("date"),
        F.lit("12:00:00").alias("time"),
        statement_amount(F.col("Amount")).alias("amount"),
        statement_description(F.col("Note"), F.col("Category"), F.col("Labels")).alias("description"),
        statement_category(F.col("Category")).alias("category"),
        statement_institution(F.col("Account")).alias("bank"),
        F.lit(None).cast("string").alias("last_four"),
        F.lit(None).cast("string").alias("account_type"),
        F.lit("expense").alias("type"),
        F.lit("cash").alias("payment_method"),
        F.lit("import_csv").alias("source"),
        F.lit(100).alias("confidence"),
        F.to_json(F.struct(*STATEMENT_COLUMNS), {"ignoreNullFields": "false"}).alias("raw_text"),
        corrupt.alias("_corrupt"),
    )
    resolved = resolve_categories(resolve_accounts(read, accounts), categories)
    amount = F.col("amount")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("_corrupt"), "corrupt row"),
            F.when(F.col("date").isNull(), "invalid date"),
            F.when(amount.isNull(), "invalid amount"),
            F.when(amount <= 0, "amount not positive"),
            F.when(F.col("cascade_account_id").isNull(), "no account"),
        )
    )
    return (
        resolved.withColumn("reasons", reasons)
        .withColumnRenamed("cascade_account_id", "account_id")
        .drop("cascade_tier", "last_four", "account_type", "_corrupt")
    )


def posted(imported: DataFrame) -> DataFrame:
    return imported.filter(F.size("reasons") == 0).drop("reasons")


def rejected(imported: DataFrame) -> DataFrame:
    return imported.filter(F.size("reasons") > 0)


def import_audit(imported: DataFrame) -> DataFrame:
    """One audit row per import: totals and a status; the error log counts each first reason.

    Counts pre-aggregate per (import, reason) on the map side, so a huge import stays cheap.
    """
    by_reason = (
        imported.withColumn("reason", F.get("reasons", F.lit(0)))
        .groupBy("import_id", "reason")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ok, bad = F.col("reason").isNull(), F.col("reason").isNotNull()
    log = F.sort_array(F.collect_list(F.when(bad, F.concat_ws(": ", "reason", F.col("n").cast("string")))))
    counted = by_reason.groupBy("import_id").agg(
        F.sum("n").alias("total_rows"),
        F.coalesce(F.sum(F.when(ok, F.col("n"))), F.lit(0)).cast("bigint").alias("imported_rows"),
        F.coalesce(F.sum(F.when(bad, F.col("n"))), F.lit(0)).cast("bigint").alias("failed_rows"),
        F.array_join(log, "; ").alias("error_log"),
    )
    return counted.withColumn(
        "status", F.when(F.col("imported_rows") > 0, "completed").otherwise("failed")
    )


def outcome_tally(outcomes: DataFrame) -> DataFrame:
    """How many messages ended as success, skipped or error."""
    return outcomes.groupBy("status").agg(F.count(F.lit(1)).alias("messages"))
