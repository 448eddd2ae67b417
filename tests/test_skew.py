"""The skew-safe building blocks give what the plain forms give."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from tallywell.operators import dedup, usage
from tallywell.plans import skew
from tallywell.plans.once import once


def test_hot_split_join_equals_plain_join(spark):
    draw = random.Random(1)
    facts = [(i, draw.choice([1, 1, 1, 2, 3, None]), f"v{i}") for i in range(300)]
    left = spark.createDataFrame(facts, "i int, k int, v string")
    right = spark.createDataFrame([(1, "a"), (3, "c"), (4, "d")], "k int, w string")
    for how in ("left", "inner"):
        plain = sorted(map(str, left.join(right, "k", how).select("i", "k", "v", "w").collect()))
        for min_rows in (1, 60, 10**9):
            split = skew.hot_split_join(left, right, ["k"], how, min_rows)
            assert split.columns == ["k", "i", "v", "w"]
            assert sorted(map(str, split.select("i", "k", "v", "w").collect())) == plain


def test_hot_and_null_keys_do_not_meet_in_one_partition(spark, tmp_path):
    """Facts from Parquet, so that nothing is folded: a hot key with a row in the other table, one without, and NULLs."""
    n, parts = 40_000, 20
    key = F.when(F.col("id") % 10 < 3, 1).when(F.col("id") % 10 < 6, -1).when(F.col("id") % 10 < 9, None).otherwise(F.col("id"))
    spark.range(n).select(key.cast("int").alias("k"), "id").write.parquet(f"{tmp_path}/facts")
    spark.range(50_000).select(F.col("id").cast("int").alias("k"), F.lit("x").alias("w")).write.parquet(f"{tmp_path}/dim")
    facts, dim = spark.read.parquet(f"{tmp_path}/facts"), spark.read.parquet(f"{tmp_path}/dim")
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions",)}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        joined = skew.hot_split_join(facts, dim, ["k"], "left", min_rows=1000)
        sizes = joined.groupBy(F.spark_partition_id()).count().collect()
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", before["spark.sql.shuffle.partitions"])
    assert "SortMergeJoin" in plan and len(sizes) == parts
    assert sum(r["count"] for r in sizes) == n and max(r["count"] for r in sizes) <= 2 * n / parts


def test_hot_keys_are_few_whatever_their_number(spark):
    facts = spark.range(30_000).select((F.col("id") % 5000).alias("k"))
    assert skew.heavy_keys(facts, ["k"], 5) is None  # none holds more than its share
    some = facts.unionByName(spark.range(2_000).select(F.lit(7).cast("long").alias("k")))
    assert [r.k for r in skew.heavy_keys(some, ["k"], 5).collect()] == [7]


def test_small_is_a_matter_of_bytes_too(spark, monkeypatch):
    wide = spark.range(10).select(F.repeat(F.lit("x"), 2_000).alias("text"))
    assert skew.is_small(wide, 10) and not skew.is_small(wide, 9)
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 10_000)
    assert not skew.is_small(wide, 10)


def test_lookup_of_a_large_table_does_not_broadcast_it(spark, monkeypatch):
    monkeypatch.setattr(skew, "is_small", lambda df, rows=0: False)
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    right = spark.createDataFrame([(1, "x")], "k int, w string")
    assert sorted(map(tuple, skew.lookup(left, right, ["k"]).collect())) == [(1, "a", "x"), (2, "b", None)]


def test_running_total(spark):
    draw = random.Random(2)
    rows = [(draw.choice(["a", "a", "b"]), draw.randrange(40), i, draw.randrange(-5, 9)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t int, id int, v int")
    got = {r.id: r.total for r in skew.running_total(df, ["k"], ["t", "id"], F.col("v"), "total").collect()}
    want, sums = {}, defaultdict(int)
    for k, _, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        sums[k] += v
        want[i] = sums[k]
    assert got == want


def test_running_total_cuts_a_burst_at_one_moment(spark):
    """One key, one stamp, many rows: still many ranges, and the numbers are those of the order."""
    rows = spark.range(20_000).select(F.lit(1).alias("k"), F.lit(5).alias("t"), "id")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = skew.running_total(rows, ["k"], ["t", "id"], F.lit(1), "n")
        assert out.filter("n = id + 1").count() == 20_000
        sizes = rows.repartitionByRange("k", "t", "id").groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) == 4 and max(r["count"] for r in sizes) < 10_000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def anchors_one_by_one(seconds):
    out = []
    for s in sorted(set(seconds)):
        if not out or s >= out[-1] + 86_400:
            out.append(s)
    return out


def test_cache_anchors_folded_and_chunked(spark):
    draw = random.Random(3)
    keys = {f"k{i}": [draw.randrange(0, 120 * 86_400) for _ in range(draw.choice([1, 5, 200]))] for i in range(12)}
    keys["dense"] = list(range(0, 90 * 86_400, 3571))
    keys["edge"] = [0, 86_399, 86_400, 172_800, 30 * 86_400 - 1, 30 * 86_400, 31 * 86_400 - 2, 31 * 86_400 - 1, 70 * 86_400]
    df = spark.createDataFrame([(k, s) for k, v in keys.items() for s in set(v)], "cache_key string, second bigint")
    for min_chunked in (1, 100, 10**9):
        got = defaultdict(list)
        for r in dedup.cache_anchors(df, min_chunked).collect():
            got[r.cache_key].append(r.second)
        assert {k: sorted(v) for k, v in got.items()} == {k: anchors_one_by_one(v) for k, v in keys.items()}


def test_quota_equals_arrival_order(spark):
    import datetime as dt

    draw = random.Random(4)
    start = dt.datetime(2024, 1, 30)
    reqs = [(i, draw.choice([1, 1, 2, 3]), start + dt.timedelta(minutes=draw.randrange(4 * 1440))) for i in range(300)]
    stored = {(1, "2024-01"): 3, (2, "2024-01"): 40}
    pro = {3}
    frames = (
        spark.createDataFrame(reqs, "request_id bigint, user_id bigint, received_at timestamp_ntz"),
        spark.createDataFrame([(u, m, n) for (u, m), n in stored.items()], "user_id bigint, month string, ai_parses_used int"),
        spark.createDataFrame([(3, "pro", "active"), (1, "pro", "canceled")], "user_id bigint, plan string, status string"),
        spark.createDataFrame([("free_ai_parses_limit", "15")], "key string, value string"),
    )
    got = {r.request_id: (r.allowed, r.used, r.limit) for r in usage.quota_admission(*frames).collect()}
    used, want = defaultdict(int, stored), {}
    for i, user, ts in sorted(reqs, key=lambda r: (r[2], r[0])):
        key = (user, ts.strftime("%Y-%m"))
        if user in pro:
            used[key] += 1
            want[i] = (True, used[key], -1)
        elif used[key] >= 15:
            want[i] = (False, used[key], 15)
        else:
            used[key] += 1
            want[i] = (True, used[key], 15)
    assert got == want


def test_once_is_a_barrier(spark):
    df = spark.createDataFrame([("a",), (None,)], "x string")
    out = once(df, {"y": F.upper("x"), "x": F.coalesce("x", F.lit("z"))})
    assert out.columns == ["x", "y"] and sorted(map(tuple, out.collect()), key=str) == [("a", "A"), ("z", None)]
    plan = out.filter(F.col("y").isNotNull())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("Generate")


def test_running_balance_carries_no_texts(spark, monkeypatch):
    """The rows are dealt out by range and written, so each column that nobody reads is moved for nothing."""
    from tallywell import catalog

    seen, run = [], catalog.posting.running_balance
    monkeypatch.setattr(catalog.posting, "running_balance", lambda ledger, *rest: seen.extend(ledger.columns) or run(ledger, *rest))
    done = catalog.QUERIES["running_balance"](spark, "/root/testdata/sf0.001")
    assert done.columns == ["id", "effect_account_id", "delta", "balance_after"]
    assert not {"raw_text", "description", "notes", "category_id"} & set(seen)
