"""Jump consistent hashing: stable keys to shards without a ring table.

The law is "key": doc_id and the number of shards decide, and one more shard takes rows only into itself. Slots number
the rows of a shard without gaps. Rows of one id, size and checksum cannot be told apart in the result, so they are
counted first; the kinds of row are counted by (shard, bucket), the counts are summed up in bucket order, and a window
numbers the kinds of one bucket only. Buckets come from the whole row, not the id, so one id on a third of all rows is many
tasks, and the copies of one row are written in runs.

Defined cases: rows with a null doc_id share one fixed key; a null text has no bytes; equal rows get different slots
in any order; an empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywell.llm.common import mix, table

ROW_BYTES = 16
#: Kinds of row of one (shard, bucket) on average.
BUCKET_ROWS = 2_000
#: Copies of one row that are written together.
RUN = 4_096
NULL_KEY = -1


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key (Lamping and Veach), all keys at once."""
    key, out = keys.astype(np.uint64), np.zeros(len(keys), np.int64)
    todo, to = np.arange(len(keys)), np.zeros(len(keys), np.int64)
    while len(todo):
        out[todo] = to[todo]
        key[todo] = key[todo] * np.uint64(2862933555777941757) + np.uint64(1)
        to[todo] = ((out[todo] + 1) * (float(1 << 31) / ((key[todo] >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
        todo = todo[to[todo] < shards]
    return out


def shard_of(key, shards: int):
    """The shard of a long column as an int column."""

    @F.pandas_udf("int")
    def run(ids: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(mix(ids.to_numpy(np.int64).view(np.uint64)), shards).astype(np.int32))

    return run(F.coalesce(key.cast("long"), F.lit(NULL_KEY).cast("long")))


def sharded(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    kind = ["doc_id", "size", "text_crc32"]
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_crc32"),
    )
    kinds = rows.groupBy(*kind).agg(F.count("*").alias("n"))
    kinds = table(kinds.withColumns({"shard": shard_of(F.col("doc_id"), shards), "grown_shard": shard_of(F.col("doc_id"), shards + 1)}), "shard-kinds")
    seen = kinds.agg(F.count("*").alias("kinds"), F.max("n").alias("most")).first()
    buckets = max(1, -(-seen["kinds"] // (shards * BUCKET_ROWS)))
    kinds = kinds.withColumn("bucket", F.pmod(F.xxhash64(*kind), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = kinds.groupBy("shard", "bucket").agg(F.sum("n").alias("rows"))
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    earlier = Window.partitionBy("shard", "bucket").orderBy(*kind).rowsBetween(Window.unboundedPreceding, -1)
    placed = kinds.withColumn("at", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(starts, ["shard", "bucket"])
    zero = F.lit(0).cast("long")
    runs = placed.withColumn("run", F.explode(F.sequence(zero, F.col("n") - 1, F.lit(RUN).cast("long"))))
    if (seen["most"] or 0) > RUN:  # one row's copies fill many runs: they spread
        runs = runs.repartition(*kind, "run")
    copy = F.explode(F.sequence(zero, F.least(F.lit(RUN), F.col("n") - F.col("run")) - 1))
    return runs.withColumn("copy", copy).select(
        *kind, F.lit("key").alias("law"), "shard", (F.col("first") + F.col("at") + F.col("run") + F.col("copy")).cast("long").alias("slot"), "grown_shard"
    )
