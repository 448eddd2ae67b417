"""Structured Streaming jobs over the batch operators.

Exactly once by construction: every micro-batch writes to a folder named after its batch id,
overwrites that folder on replay, and reads only folders of earlier batches as its state.
Nothing is kept in a driver or executor between batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from tallywell.fixed_values import CACHE_TTL_SECONDS
from tallywell.operators import dedup, posting, usage
from tallywell.operators.sinks import write_batch
from tallywell.plans import flows
from tallywell.plans.skew import lookup
from tallywell.session import materialise
from tallywell.sources.messages import spread


def earlier(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """What batches before this one wrote, or None where none has written a row; any other failure to read is an error."""
    try:
        written = spark.read.parquet(path)
    except AnalysisException as problem:
        # no folder yet, or batches without a single row left folders without files
        if problem.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    return written.filter(F.col("batch_id") < batch_id).drop("batch_id")


def start(stream: DataFrame, step, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Run ``step(batch, batch_id)`` on each micro-batch."""
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


# -- ingest ------------------------------------------------------------------------------
#: Folders the ledger's index is cut into by owner, and what duplicates are looked for by.
OWNER_BUCKETS = 64
INDEXED = ["id", "message_id", "user_id", "source", "raw_text", "date", "amount", "account_id", "created_at", "deleted_at"]


def owner_bucket() -> Column:
    return F.pmod(F.xxhash64("user_id"), F.lit(OWNER_BUCKETS)).cast("int")


def ingest_stream(
    shaped: DataFrame, accounts: DataFrame, categories: DataFrame, rules: DataFrame,
    out: str, checkpoint: str, available_now: bool = True,
) -> StreamingQuery:
    """Messages to ledger, skipped and rejects folders under ``out``.

    Duplicates are looked for in the micro-batch and in an index of the stored ledger: the
    columns that tell duplicates, in folders by owner. A batch reads the folders of its own
    owners only, never the ledger.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        history = earlier(spark, f"{out}/index", batch_id)
        if history is not None:
            named = [r["bucket"] for r in batch.select(owner_bucket().alias("bucket")).distinct().collect()]  # OWNER_BUCKETS at most
            owners = batch.select("user_id").distinct().withColumn("_named", F.lit(True))
            history = lookup(history.filter(F.col("bucket").isin(named)), owners, ["user_id"], "inner").drop("_named", "bucket")
        done = flows.ingest(spread(batch), accounts, categories, rules, history)
        write_batch(done.ledger, f"{out}/ledger", batch_id)
        write_batch(done.skipped, f"{out}/skipped", batch_id)
        write_batch(done.rejects, f"{out}/rejects", batch_id)
        written = spark.read.parquet(f"{out}/ledger/batch_id={batch_id}").select(*INDEXED).withColumn("bucket", owner_bucket())
        written.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/index/batch_id={batch_id}")

    return start(shaped, step, checkpoint, available_now)


# -- 24-hour de-duplication --------------------------------------------------------------
def cache_stream(
    messages: DataFrame, out: str, checkpoint: str, available_now: bool = True,
    keyed: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Cache hit or miss per message (see ``dedup.cache_hits``) across micro-batches.

    The messages are keyed already, or ``keyed`` does so with each micro-batch, dealt out to
    more tasks than its files have splits.

    State is the folder of misses. A miss matters for 24 hours, and the misses are stored by
    day, so a batch reads the days it can depend on and no others.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = materialise(keyed(spread(batch)) if keyed else batch, "cache-batch")
        misses = earlier(spark, f"{out}/misses", batch_id)
        last = None
        if misses is not None:
            first = batch.agg((F.min("second") - CACHE_TTL_SECONDS).alias("second")).scalar()
            since = F.floor(first / 86_400)
            last = (
                misses.filter(F.col("day") >= since)
                .groupBy("cache_key")
                .agg(F.max("second").alias("last_anchor"))
            )
        flagged = materialise(dedup.cache_hits(batch, before=last), "cache-flagged")
        write_batch(flagged, f"{out}/flagged", batch_id)
        stored = flagged.filter(F.col("is_transaction") & ~F.col("cache_hit")).select(
            "cache_key", "second", F.floor(F.col("second") / 86_400).alias("day")
        )
        stored.write.mode("overwrite").partitionBy("day").parquet(f"{out}/misses/batch_id={batch_id}")

    return start(messages, step, checkpoint, available_now)


# -- balances ----------------------------------------------------------------------------
def balance_stream(ledger: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Net effect per account, kept in streaming state; each batch writes what changed.

    The update-mode output of a batch is exactly the set of changed accounts, at both ends
    of a transfer.
    """
    totals = (
        posting.balance_effects(ledger)
        .groupBy(F.col("effect_account_id").alias("account_id"))
        .agg(F.sum("delta").cast(posting.TOTAL).alias("delta"), F.count(F.lit(1)).alias("effects"))
    )

    def step(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, f"{out}/changed", batch_id)

    writer = totals.writeStream.outputMode("update").foreachBatch(step)
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest_balances(spark: SparkSession, out: str) -> DataFrame:
    """The last written total of each account."""
    changed = spark.read.parquet(f"{out}/changed")
    last = F.max_by(F.struct("delta", "effects"), "batch_id")
    return changed.groupBy("account_id").agg(last.alias("t")).select("account_id", "t.*")


# -- quota -------------------------------------------------------------------------------
def quota_stream(
    requests: DataFrame, stored: DataFrame, subscriptions: DataFrame, settings: DataFrame,
    out: str, checkpoint: str, available_now: bool = True,
) -> StreamingQuery:
    """Admission per request; counters are the stored ones plus what earlier batches admitted."""
    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = materialise(batch, "quota-batch")
        counters = stored.select("user_id", "month", F.col("ai_parses_used").cast("bigint").alias("n"))
        before = earlier(spark, f"{out}/admitted", batch_id)
        if before is not None:
            months = batch.select(usage.usage_month(F.col("received_at")).alias("month")).distinct()
            named = lookup(before, months.withColumn("_named", F.lit(True)), ["month"], "inner")
            counters = counters.unionByName(named.select("user_id", "month", "n"))
        prior = counters.groupBy("user_id", "month").agg(F.sum("n").alias("ai_parses_used"))
        decided = materialise(
            usage.quota_admission(batch, prior, subscriptions, settings), "quota-decided"
        )
        write_batch(decided, f"{out}/decided", batch_id)
        admitted = decided.filter("allowed").groupBy("user_id", "month").agg(F.count(F.lit(1)).alias("n"))
        admitted.write.mode("overwrite").partitionBy("month").parquet(f"{out}/admitted/batch_id={batch_id}")

    return start(requests, step, checkpoint, available_now)


# -- retention and change feed -----------------------------------------------------------
def run_retention(spark: SparkSession, usage_path: str, out: str, now: Column) -> None:
    """The monthly clean-up: the kept usage rows as a new version of the table."""
    usage.retained(spark.read.parquet(usage_path), now).write.mode("overwrite").parquet(out)


def change_feed(spark: SparkSession, path: str, schema, files_per_trigger: int = 1000) -> DataFrame:
    """Rows appended to a table since the consumer's last checkpoint."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
