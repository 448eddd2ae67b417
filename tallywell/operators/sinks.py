"""Writing the ledger and its side tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append_ledger(ledger: DataFrame, path: str) -> None:
    """Append, one folder per ledger month so that period filters prune.

    Rows are rebalanced by month first: small months share a task, a huge one is split, and
    no task writes a file into every folder.
    """
    months = ledger.withColumn("month", F.date_format("date", "yyyy-MM"))
    months.hint("rebalance", F.col("month")).write.mode("append").partitionBy("month").parquet(path)


def write_batch(df: DataFrame, path: str, batch_id: int, mode: str = "overwrite") -> None:
    """One folder per micro-batch, overwritten on replay, so that a retry leaves one copy."""
    df.write.mode(mode).parquet(f"{path}/batch_id={batch_id}")


def append_skipped(skipped: DataFrame, path: str) -> None:
    """The skipped-message audit."""
    skipped.select(
        "message_id", "user_id", F.col("text").alias("raw_text"), "source", "reason", "parsed_data",
        F.col("received_at").alias("created_at"),
    ).write.mode("append").parquet(path)


def append_rejects(rejects: DataFrame, reason: Column, path: str) -> None:
    """Bad rows as JSON beside the reason; the good ones went on."""
    rejects.select(
        reason.alias("reason"), F.to_json(F.struct(*rejects.columns)).alias("record")
    ).write.mode("append").parquet(path)


def append_rules(rules: DataFrame, path: str) -> None:
    """Add rule rows; ``ai_prompt`` is kept where the rule has one, no rows are no change."""
    if "ai_prompt" not in rules.columns:
        rules = rules.withColumn("ai_prompt", F.lit(None).cast("string"))
    rules.write.mode("append").parquet(path)


def export_csv(ledger: DataFrame, path: str) -> None:
    """CSV with a header; nested columns become JSON text."""
    nested = {"array", "struct", "map"}
    shown = [
        F.to_json(f.name).alias(f.name) if f.dataType.typeName() in nested else F.col(f.name)
        for f in ledger.schema.fields
    ]
    ledger.select(*shown).write.mode("overwrite").option("header", True).csv(path)


def changes_since(df: DataFrame, high_water: Column) -> DataFrame:
    """Rows touched after the high-water mark."""
    return df.filter(F.col("updated_at") > high_water)
