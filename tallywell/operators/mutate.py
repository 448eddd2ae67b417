"""Table changes as new versions of a table: soft delete, edits, cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywell.plans.skew import hot_split_join, lookup

MONEY = "decimal(15,2)"


def stamp(df: DataFrame, run_ts: Column, changed: Column) -> DataFrame:
    """``updated_at`` moves to the run's time on changed rows only."""
    return df.withColumn("updated_at", F.when(changed, run_ts).otherwise(F.col("updated_at")))


def with_account_defaults(accounts: DataFrame) -> DataFrame:
    """Column defaults of a new account row."""
    return accounts.withColumns(
        {
            "currency": F.coalesce("currency", F.lit("COP")),
            "balance": F.coalesce("balance", F.lit(0).cast(MONEY)),
            "is_active": F.coalesce("is_active", F.lit(True)),
        }
    )


def soft_delete(df: DataFrame, ids: DataFrame, id_column: str, run_ts: Column) -> DataFrame:
    """Rows in ``ids`` get ``deleted_at``; a row already deleted keeps its time."""
    marked = lookup(df, ids.select(id_column).distinct().withColumn("_gone", F.lit(True)), [id_column])
    gone = F.col("_gone").isNotNull()
    return marked.withColumn(
        "deleted_at", F.when(gone, F.coalesce(F.col("deleted_at"), run_ts)).otherwise(F.col("deleted_at"))
    ).drop("_gone")


def bulk_edit(ledger: DataFrame, edits: DataFrame) -> DataFrame:
    """New type, category or account per id; a NULL in the edit leaves the field."""
    fields = ["type", "category_id", "account_id"]
    new = edits.select("id", *[F.col(f).alias(f"new_{f}") for f in fields])
    return lookup(ledger, new, ["id"]).withColumns(
        {f: F.coalesce(f"new_{f}", f) for f in fields}
    ).drop(*[f"new_{f}" for f in fields])


def resolve_duplicates(ledger: DataFrame, decisions: DataFrame, run_ts: Column) -> DataFrame:
    """Apply (id, decision) to flagged rows.

    keep_both confirms the flagged row; delete_flagged soft-deletes it; replace soft-deletes
    the original and clears the flag.
    """
    flagged = lookup(ledger, decisions.select("id", "decision"), ["id"])
    replaced = (
        flagged.filter(F.col("decision") == "replace")
        .select(F.col("duplicate_of").alias("id"))
        .filter(F.col("id").isNotNull())
        .distinct()
        .withColumn("_replaced", F.lit(True))
    )
    decision = F.col("decision")
    delete = (decision == "delete_flagged") | F.col("_replaced").isNotNull()
    return (
        hot_split_join(flagged, replaced, ["id"])
        .withColumns(
            {
                "deleted_at": F.when(delete, F.coalesce(F.col("deleted_at"), run_ts)).otherwise(
                    F.col("deleted_at")
                ),
                "duplicate_status": F.when(decision == "keep_both", "confirmed")
                .when(decision == "replace", F.lit(None))
                .otherwise(F.col("duplicate_status")),
                "duplicate_of": F.when(decision == "replace", F.lit(None)).otherwise(
                    F.col("duplicate_of")
                ),
            }
        )
        .drop("decision", "_replaced")
    )


def adjust_balances(accounts: DataFrame, targets: DataFrame) -> DataFrame:
    """(account_id, target_balance) to adjustment rows that move each balance there."""
    known = accounts.select(
        "account_id", "user_id", F.coalesce("balance", F.lit(0).cast(MONEY)).alias("balance")
    )
    difference = (F.col("target_balance") - F.col("balance")).cast(MONEY)
    return (
        targets.join(known, "account_id")
        .withColumn("difference", difference)
        .filter(F.col("difference") != 0)
        .select(
            "account_id",
            "user_id",
            F.abs("difference").alias("amount"),
            F.when(F.col("difference") > 0, "income").otherwise("expense").alias("type"),
            F.lit("Balance adjustment").alias("description"),
        )
    )


def set_balances(accounts: DataFrame, targets: DataFrame) -> DataFrame:
    """The direct form: the balance becomes the target."""
    return accounts.join(targets, "account_id", "left").withColumn(
        "balance", F.coalesce("target_balance", "balance")
    ).drop("target_balance")


# -- what deleting a row does to the rows that name it -----------------------------------
def cascade(df: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    """Rows that do not name a deleted id (ON DELETE CASCADE)."""
    marked = lookup(df, gone.distinct().withColumn("_gone", F.lit(True)), [column])
    return marked.filter(F.col("_gone").isNull()).drop("_gone").select(*df.columns)


def set_null(df: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    """References to deleted ids become NULL (ON DELETE SET NULL)."""
    marked = lookup(df, gone.distinct().withColumn("_gone", F.lit(True)), [column])
    kept = F.when(F.col("_gone").isNull(), F.col(column))
    return marked.withColumn(column, kept).drop("_gone").select(*df.columns)


def delete_categories(
    categories: DataFrame, ledger: DataFrame, ids: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(categories left, ledger unlinked, refused ids).

    Default categories are refused. Deleting a parent takes its children along; the ledger
    rows of every deleted category lose their category.
    """
    asked = categories.join(ids.select("category_id").distinct(), "category_id", "left_semi")
    refused = asked.filter(F.col("is_default")).select("category_id")
    roots = asked.filter(~F.coalesce("is_default", F.lit(False))).select("category_id")
    children = categories.join(
        roots.withColumnRenamed("category_id", "parent_id"), "parent_id", "left_semi"
    ).select("category_id")
    gone = roots.unionByName(children).distinct()
    return (
        categories.join(gone, "category_id", "left_anti"),
        set_null(ledger, "category_id", gone),
        refused,
    )
