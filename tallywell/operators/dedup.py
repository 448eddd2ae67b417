"""Exact and near duplicates, and the 24-hour parse cache, in closed form."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywell.fixed_values import CACHE_KEY_PREFIX, CACHE_TTL_SECONDS
from tallywell.functions.text import wide_trim
from tallywell.operators.resolve import not_deleted
from tallywell.plans.skew import hot_split_join
from tallywell.session import materialise


def _earliest(stored: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Per key the stored row that came first, as struct(created_at, message_id, id)."""
    first = F.min(F.struct("created_at", "message_id", "id"))
    return stored.dropna(subset=keys).groupBy(*keys).agg(first.alias(out))


def _text_key(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _came_before(stored: Column) -> Column:
    """Whether the earliest stored row is older than the current one.

    Messages compare by (created_at, message_id); the two legs of one message are not each
    other's past.
    """
    return (stored["created_at"] < F.col("created_at")) | (
        (stored["created_at"] == F.col("created_at"))
        & (stored["message_id"] < F.col("message_id"))
    )


def exact_duplicates(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Add ``exact_of``: the earliest older stored row with the same owner, source and text.

    A row has an older twin exactly when the earliest row of its key is older, so one
    pre-aggregated minimum per key replaces all pairs. ``stored`` may be ``rows`` itself.
    """
    keyed = rows.withColumn("_text", _text_key(F.col("raw_text")))
    first = _earliest(
        not_deleted(stored).withColumn("_text", _text_key(F.col("raw_text"))),
        ["user_id", "source", "_text"],
        "_first",
    )
    joined = hot_split_join(keyed, first, ["user_id", "source", "_text"])
    exact = F.when(_came_before(F.col("_first")), F.col("_first.id"))
    return joined.withColumn("exact_of", exact).drop("_text", "_first")


def near_duplicates(
    rows: DataFrame,
    stored: DataFrame,
    account: str = "account_id",
    counted: DataFrame | None = None,
) -> DataFrame:
    """Add ``near_of``: the earliest older stored row with the same owner, day, amount, account.

    The new row counts with the account it had before rules (``account``), the stored one
    with the ``account_id`` it was stored under.
    """
    keys = ["user_id", "date", "amount", account]
    known = not_deleted(stored).withColumn(account, F.col("account_id"))
    joined = hot_split_join(rows, _earliest(known, keys, "_first"), keys, counted=counted)
    near = F.when(_came_before(F.col("_first")), F.col("_first.id"))
    return joined.withColumn("near_of", near).drop("_first")


def flag_duplicates(rows: DataFrame, stored: DataFrame, account: str = "account_id") -> DataFrame:
    """Add ``duplicate_status`` and ``duplicate_of``: exact first, else near."""
    both = near_duplicates(exact_duplicates(rows, stored), stored, account, counted=rows)
    of = F.coalesce("exact_of", "near_of")
    return both.withColumns(
        {"duplicate_of": of, "duplicate_status": F.when(of.isNotNull(), "pending_review")}
    ).drop("exact_of", "near_of")


def side_by_side(ledger: DataFrame) -> DataFrame:
    """Each flagged row beside the row it duplicates."""
    shown = ["date", "amount", "account_id", "description"]
    flagged = ledger.filter(F.col("duplicate_status").isNotNull()).select(
        "id", "duplicate_status", "duplicate_of", *shown
    )
    original = ledger.select(
        F.col("id").alias("duplicate_of"), *[F.col(c).alias(f"original_{c}") for c in shown]
    )
    return hot_split_join(flagged, original, ["duplicate_of"])


# -- the 24-hour cache -------------------------------------------------------------------
CHUNK_SECONDS = 30 * 86_400
FOLD_SECONDS = 50_000  # arrival seconds a key may have to be folded in one array


def cache_key(text: Column, prompts: Column | None = None) -> Column:
    """Cache key of a text and the prompts sent with it: SHA-256 of the trimmed lower case."""
    sent = text if prompts is None else F.concat(text, F.coalesce(prompts, F.lit("")))
    return F.concat(F.lit(CACHE_KEY_PREFIX), F.sha2(F.lower(wide_trim(sent)), 256))


def cache_hits(
    messages: DataFrame, min_chunked: int = FOLD_SECONDS, before: DataFrame | None = None
) -> DataFrame:
    """Add ``cache_hit`` to messages with cache_key, second, message_id and is_transaction (valid ones).

    A miss stores its result for 24 hours and hits do not prolong it, so the stored moments
    (anchors) of a key are a chain: the first arrival, then the first arrival at least 24
    hours after the last anchor, and so on. Non-transactions are never stored. The clock
    ticks in whole seconds; among arrivals in an anchor's second the first is the miss.
    """
    seconds = materialise(
        messages.filter("is_transaction")
        .groupBy("cache_key", "second")
        .agg(F.min("message_id").alias("first_id")),
        "cache-seconds",
    )
    anchors = cache_anchors(seconds.select("cache_key", "second"), min_chunked, before)
    misses = (
        seconds.join(anchors, ["cache_key", "second"], "left_semi")
        .select("cache_key", F.col("first_id").alias("message_id"))
        .withColumn("_miss", F.lit(True))
    )
    joined = messages.join(misses, ["cache_key", "message_id"], "left")
    hit = F.col("is_transaction") & F.col("_miss").isNull()
    return joined.withColumn("cache_hit", hit).drop("_miss")


def cache_anchors(
    seconds: DataFrame, min_chunked: int = FOLD_SECONDS, before: DataFrame | None = None
) -> DataFrame:
    """The anchor seconds of each key, from its distinct arrival seconds.

    ``before`` may give (cache_key, last_anchor) from earlier data: arrivals within 24 hours
    of it are hits, and the chain starts at the first one past them. Keys with few arrivals
    fold their sorted seconds in one array. A busy key is cut into 30-day chunks of at most
    2,592,000 seconds: each chunk works out, for every arrival that could be its first
    anchor, the last anchor it would end with; a walk over these summaries finds the true
    first anchor of each chunk, and each chunk then lists its anchors on its own.
    """
    if before is not None:
        opens = F.col("last_anchor") + CACHE_TTL_SECONDS
        seconds = (
            hot_split_join(seconds, before, ["cache_key"])
            .filter(F.col("last_anchor").isNull() | (F.col("second") >= opens))
            .drop("last_anchor")
        )
    counts = seconds.groupBy("cache_key").agg(F.count(F.lit(1)).alias("_n"))
    tagged = hot_split_join(seconds, counts, ["cache_key"])
    few = tagged.filter(F.col("_n") < min_chunked)
    many = tagged.filter(F.col("_n") >= min_chunked)
    return _folded_anchors(few).unionByName(_chunked_anchors(many.drop("_n")))


def _folded_anchors(seconds: DataFrame) -> DataFrame:
    def step(anchors: Column, second: Column) -> Column:
        due = F.coalesce(second >= F.element_at(anchors, -1) + CACHE_TTL_SECONDS, F.lit(True))
        return F.when(due, F.concat(anchors, F.array(second))).otherwise(anchors)

    ordered = F.sort_array(F.collect_list("second"))
    start = F.slice(ordered, 1, 1)
    anchors = F.aggregate(ordered, start, step)
    return seconds.groupBy("cache_key").agg(anchors.alias("_anchors")).select(
        "cache_key", F.explode("_anchors").alias("second")
    )


def _following(times: np.ndarray) -> np.ndarray:
    """For each position, that of the first arrival at least 24 hours later."""
    return np.searchsorted(times, times + CACHE_TTL_SECONDS)


def _sorted_seconds(table: pa.Table) -> np.ndarray:
    return np.sort(table.column("second").to_numpy())


def _chunk_exits(key: tuple, table: pa.Table) -> pa.Table:
    """(entry, last_anchor) for each arrival that may be the chunk's first anchor.

    The anchor before the chunk is older than its start, so the next one is due within its
    first 24 hours: the candidates are the arrivals of that day and the one after them.
    """
    times, begin = _sorted_seconds(table), key[1].as_py() * CHUNK_SECONDS
    first_day = int(np.searchsorted(times, begin + CACHE_TTL_SECONDS))
    entries = np.arange(min(first_day + 1, len(times)))
    following, at = _following(times), entries.copy()
    while (going := following[at] < len(times)).any():
        at = np.where(going, following[at], at)
    return pa.table(
        {
            "cache_key": pa.repeat(key[0], len(entries)),
            "chunk": pa.repeat(key[1], len(entries)),
            "entry": times[entries],
            "last_anchor": times[at],
        }
    )


def _walk_chunks(key: tuple, table: pa.Table) -> pa.Table:
    """The true entry of each chunk: the first candidate 24 hours past the anchor before it."""
    ordered = table.sort_by([("chunk", "ascending"), ("entry", "ascending")])
    chunk, entry, last = (ordered.column(c).to_numpy() for c in ("chunk", "entry", "last_anchor"))
    numbers, starts = np.unique(chunk, return_index=True)
    ends = np.append(starts[1:], len(chunk))
    due, chunks, entries = np.iinfo(np.int64).min, [], []
    for number, lo, hi in zip(numbers, starts, ends):
        at = lo + int(np.searchsorted(entry[lo:hi], due))
        if at < hi:
            chunks.append(int(number))
            entries.append(int(entry[at]))
            due = int(last[at]) + CACHE_TTL_SECONDS
    return pa.table(
        {
            "cache_key": pa.repeat(key[0], len(chunks)),
            "chunk": pa.array(chunks, pa.int64()),
            "entry": pa.array(entries, pa.int64()),
        }
    )


def _chunk_anchors(key: tuple, table: pa.Table) -> pa.Table:
    """The anchors of one chunk, from its known first one."""
    times = _sorted_seconds(table)
    following, found = _following(times), []
    at = int(np.searchsorted(times, table.column("entry")[0].as_py()))
    while at < len(times):
        found.append(int(times[at]))
        at = int(following[at])
    return pa.table(
        {"cache_key": pa.repeat(key[0], len(found)), "second": pa.array(found, pa.int64())}
    )


def _chunked_anchors(seconds: DataFrame) -> DataFrame:
    number = F.floor(F.col("second") / CHUNK_SECONDS).cast("bigint")
    chunks = seconds.withColumn("chunk", number)
    exits = chunks.groupBy("cache_key", "chunk").applyInArrow(
        _chunk_exits, "cache_key string, chunk bigint, entry bigint, last_anchor bigint"
    )
    entries = exits.groupBy("cache_key").applyInArrow(
        _walk_chunks, "cache_key string, chunk bigint, entry bigint"
    )
    return (
        chunks.join(entries, ["cache_key", "chunk"])
        .groupBy("cache_key", "chunk")
        .applyInArrow(_chunk_anchors, "cache_key string, second bigint")
    )
