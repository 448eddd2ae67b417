"""Constraint, uniqueness and reference checks; each returns the offending rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywell.fixed_values import (
    ACCOUNT_TYPES,
    CONDITION_LOGICS,
    IMPORT_STATUSES,
    PLANS,
    RECONCILIATION_STATUSES,
    RULE_TYPES,
    SPENDING_NATURES,
    SUBSCRIPTION_STATUSES,
    TRANSACTION_TYPES,
)
from tallywell.plans.skew import lookup


def in_domain(column: str, domain: Sequence[str]) -> Column:
    return F.col(column).isin(*domain)


def at_most(column: str, length: int) -> Column:
    return F.length(column) <= length


def transaction_checks() -> dict[str, tuple[str, Column]]:
    return {
        "type in domain": ("type", in_domain("type", TRANSACTION_TYPES)),
        "amount positive": ("amount", F.col("amount") > 0),
        "confidence 0 to 100": ("confidence", F.col("confidence").between(0, 100)),
        "account given": ("account_id", F.col("account_id").isNotNull()),
        "owner given": ("user_id", F.col("user_id").isNotNull()),
        "date given": ("date", F.col("date").isNotNull()),
        "amount given": ("amount", F.col("amount").isNotNull()),
        "description given": ("description", F.col("description").isNotNull()),
        "source at most 50": ("source", at_most("source", 50)),
        "time given": ("time", F.col("time").isNotNull()),
        "source given": ("source", F.col("source").isNotNull()),
        "payment method at most 50": ("payment_method", at_most("payment_method", 50)),
    }


def account_checks() -> dict[str, tuple[str, Column]]:
    return {
        "type in domain": ("type", in_domain("type", ACCOUNT_TYPES)),
        "name given": ("name", F.col("name").isNotNull()),
        "name at most 100": ("name", at_most("name", 100)),
        "last four at most 4": ("last_four", at_most("last_four", 4)),
        "owner given": ("user_id", F.col("user_id").isNotNull()),
    }


def category_checks() -> dict[str, tuple[str, Column]]:
    return {
        "type in domain": ("type", in_domain("type", TRANSACTION_TYPES)),
        "nature in domain": ("spending_nature", in_domain("spending_nature", SPENDING_NATURES)),
        "slug given": ("slug", F.col("slug").isNotNull()),
    }


def rule_checks() -> dict[str, tuple[str, Column]]:
    return {
        "rule type in domain": ("rule_type", in_domain("rule_type", RULE_TYPES)),
        "logic in domain": ("condition_logic", in_domain("condition_logic", CONDITION_LOGICS)),
        "owner given": ("user_id", F.col("user_id").isNotNull()),
        "name given": ("name", F.col("name").isNotNull()),
        "name at most 200": ("name", at_most("name", 200)),
        "conditions given": ("conditions", F.col("conditions").isNotNull()),
        "actions given": ("actions", F.col("actions").isNotNull()),
    }


def subscription_checks() -> dict[str, tuple[str, Column]]:
    return {
        "plan in domain": ("plan", in_domain("plan", PLANS)),
        "status in domain": ("status", in_domain("status", SUBSCRIPTION_STATUSES)),
    }


def import_checks() -> dict[str, tuple[str, Column]]:
    return {"status in domain": ("status", in_domain("status", IMPORT_STATUSES))}


def reconciliation_checks() -> dict[str, tuple[str, Column]]:
    return {
        "status in domain": ("status", in_domain("status", RECONCILIATION_STATUSES)),
        "account given": ("account_id", F.col("account_id").isNotNull()),
    }


def skipped_checks() -> dict[str, tuple[str, Column]]:
    return {"raw text given": ("raw_text", F.col("raw_text").isNotNull())}


def violations(
    df: DataFrame, table: str, id_column: str, checks: Mapping[str, tuple[str, Column]]
) -> DataFrame:
    """(table, row id, rule, value) for each check a row fails, in one scan.

    As in SQL a check that evaluates to NULL passes.
    """
    failed = F.array_compact(
        F.array(
            *[
                F.when(
                    ~F.coalesce(check, F.lit(True)),
                    F.struct(F.lit(rule).alias("rule"), F.col(column).cast("string").alias("value")),
                )
                for rule, (column, check) in checks.items()
            ]
        )
    )
    return df.select(
        F.lit(table).alias("table_name"),
        F.col(id_column).cast("string").alias("row_id"),
        F.explode(failed).alias("_failed"),
    ).select("table_name", "row_id", "_failed.*")


def not_unique(df: DataFrame, table: str, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("rows"))
        .filter(F.col("rows") > 1)
        .select(
            F.lit(table).alias("table_name"),
            F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key"),
            "rows",
        )
    )


def orphans(
    df: DataFrame, table: str, id_column: str, column: str, parent: DataFrame, parent_column: str
) -> DataFrame:
    """Rows whose reference points at nothing.

    Distinct references are checked first, so a reference most rows share is looked up once
    and only missing ones (few in a sound ledger) are joined back.
    """
    used = df.select(F.col(column).alias("_ref")).filter(F.col("_ref").isNotNull()).distinct()
    known = parent.select(F.col(parent_column).alias("_ref")).distinct()
    missing = (
        used.join(known, "_ref", "left_anti")
        .withColumnRenamed("_ref", column)
        .withColumn("_lost", F.lit(True))
    )
    return lookup(df, missing, [column]).filter("_lost").select(
        F.lit(table).alias("table_name"),
        F.col(id_column).cast("string").alias("row_id"),
        F.lit(column).alias("reference"),
        F.col(column).cast("string").alias("value"),
    )
