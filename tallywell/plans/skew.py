"""Join and window building blocks that stay balanced when one key holds most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywell.session import materialise

BROADCAST_ROWS = 200_000
BROADCAST_RULES = 50_000  # rule rows carry JSON documents, so fewer of them
BROADCAST_BYTES = 64 << 20  # of the rows as JSON text
HOT_SHARE = 2_000  # a key with a larger share of the rows than 1 / HOT_SHARE is hot, so there are fewer than that
HOT_MIN_ROWS = 1_000_000  # below this a key is one ordinary task's work
ROW_IDS = ("message_id", "id", "request_id", "row_id")  # what tells rows of one key apart


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a table has at most ``rows`` rows and few enough bytes; reads no more than it needs to tell."""
    head = df.limit(rows + 1).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("bytes")
    )
    seen = head.first()
    return seen["n"] <= rows and (seen["bytes"] or 0) <= BROADCAST_BYTES


def lookup(
    facts: DataFrame,
    dim: DataFrame,
    on: Sequence[str],
    how: str = "left",
    known_small: bool = False,
    costly: bool = False,
) -> DataFrame:
    """Join facts to a table with at most one row per key.

    A dimension that is counted and found small (or reduced from a table that was) is
    broadcast, so facts do not move. A larger one is joined by shuffle with the heavy keys
    taken out first, which reads the facts twice: ``costly`` facts are written down before.
    """
    if known_small or is_small(dim):
        return facts.join(F.broadcast(dim), list(on), how)
    return hot_split_join(materialise(facts, "facts") if costly else facts, dim, on, how)


def heavy_keys(facts: DataFrame, on: Sequence[str], min_rows: int) -> DataFrame | None:
    """The keys with at least ``min_rows`` rows and a 1 / HOT_SHARE share: fewer than HOT_SHARE keys.

    Counted with partial sums on the map side over the key columns alone. The keys found
    come back as a literal table, so the count does not run again inside the join.
    """
    least = max(min_rows, facts.count() // HOT_SHARE + 1) if min_rows > 1 else 1
    heavy = facts.dropna(subset=list(on)).groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select(*on)
    found = heavy.collect()
    return facts.sparkSession.createDataFrame(found, heavy.schema) if found else None


def hot_split_join(
    facts: DataFrame,
    dim: DataFrame,
    on: Sequence[str],
    how: str = "left",
    min_rows: int = HOT_MIN_ROWS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Shuffle join to a unique-key table, exact for any skew on the fact side.

    Hot keys get their dimension row by broadcast; their fact rows, and rows with a NULL key,
    carry a hash of their own as slice, so that they spread over all partitions instead of
    meeting in one. Every other row joins by plain equality in the same pass. ``counted``
    may give a table that is cheaper to read than the facts and holds the same keys as often.

    The dimension's slice is 0 for every row, but computed from its key: a literal would be
    folded into a filter, and the rows would be dealt out by the key alone.
    """
    on = list(on)
    values = [c for c in dim.columns if c not in on]
    spread_by = [c for c in ROW_IDS if c in facts.columns] or [
        f.name for f in facts.schema.fields if f.dataType.typeName() != "map"
    ]
    own = F.xxhash64(*spread_by)
    slice_no = F.when(own == 0, F.lit(1).cast("bigint")).otherwise(own)
    no_slice = F.lit(0).cast("bigint")
    dim_slice = F.pmod(F.xxhash64(*on), F.lit(1).cast("bigint"))
    no_key = F.lit(False)
    for name in on:
        no_key = no_key | F.col(name).isNull()

    packed = dim.select(*on, F.struct(F.lit(True).alias("_hit"), *values).alias("_row"))
    hot = heavy_keys(facts if counted is None else counted, on, min_rows)
    if hot is None:
        marked = facts.withColumn("_slice", F.when(no_key, slice_no).otherwise(no_slice))
        row = F.col("_row")
    else:
        hot_rows = packed.join(F.broadcast(hot), on, "left_semi").withColumnRenamed("_row", "_hot")
        is_hot = F.col("_is_hot").isNotNull()
        marked = (
            facts.join(F.broadcast(hot.withColumn("_is_hot", F.lit(True))), on, "left")
            .join(F.broadcast(hot_rows), on, "left")
            .withColumn("_slice", F.when(is_hot | no_key, slice_no).otherwise(no_slice))
        )
        row = F.when(is_hot, F.col("_hot")).otherwise(F.col("_row"))
    joined = marked.join(packed.withColumn("_slice", dim_slice), [*on, "_slice"], "left")
    if how == "inner":
        joined = joined.filter(row.getField("_hit"))
    out = [F.col(c) for c in on]
    out += [F.col(c) for c in facts.columns if c not in on]
    out += [row.getField(v).alias(v) for v in values]
    return joined.select(*out)


def running_total(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str) -> DataFrame:
    """Inclusive running sum of ``value`` per key in ``order``, without one task per key.

    The rows are dealt out in ranges of (key, order) and written down with the number of their
    range, so a key with most of the rows, or with most of them at one moment, is cut evenly.
    A range's sums per key are carried forward over the ranges of the key, of which there
    are no more than partitions, and the row-level window runs inside a range. ``order``
    must tell rows of a key apart, or ties are summed up in any order.
    """
    keys = list(keys)
    dealt = rows.withColumn("_value", value).repartitionByRange(*keys, *order)
    placed = materialise(dealt.withColumn("_chunk", F.spark_partition_id()), "ranges")
    sums = placed.groupBy(*keys, "_chunk").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*keys, "_chunk", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_carry"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("_value").over(inside) + F.col("_carry")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    carried = carried.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_chunk").alias("_at"), "_carry")
    joined = placed.join(carried, [*same, F.col("_chunk") == F.col("_at")])
    return joined.withColumn(out, total).drop("_chunk", "_at", "_carry", "_value", *[f"_{k}" for k in keys])


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows per key. Spark keeps k per key on the map side before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")
