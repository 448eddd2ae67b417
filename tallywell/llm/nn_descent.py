"""Embedding near-duplicates by NN-descent.

Equal vectors are one class from the start. Random-projection leaves give each class a first list of neighbours; rounds
of NN-descent then let the neighbours of each vector meet each other and keep the best of each list, until lists hardly
change. Links are the pairs of a list at or above the threshold, recomputed in double precision.

A list that is full of links is saturated: there may be more than it holds. The members of all components with such a
list are crowded, and their links are counted exactly: a component is a ball around one of its members, balls are compared
with each other in blocks, and the members of two components meet only where the triangle inequality lets their balls
hold vectors within the threshold angle. They meet in blocks that give counts and the components that links join, never pairs.

Recall is audited against brute force on what the crowded ones do not decide: AUDIT_QUERIES other vectors chosen by a
hash, compared with all vectors in blocks. The share of links found and the mean share by query must both reach RECALL. As
long as they do not, leaves of a new seed join wider lists, all entries count as fresh again, and further rounds
follow. If the audit still fails in round MAX_ROUNDS, the components of all vectors are compared in this way, which is exact.

Defined cases: every row gives a row. Rows are told apart by their vectors, so a vec_id that stands on several vectors has a
row, links and component for each. Vectors that are null, empty, zero or hold null or non-finite components link with
nothing and are their own component; vectors of different lengths never link (shorter ones are padded with zeros and only
meet their own length); repeated rows are copies of each other; a null vec_id links with nothing and is kept; labels and
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywell.llm.common import per_group, table
from tallywell.llm.components import components
from tallywell.plans.skew import hot_split_join

NEIGHBOURS, TREES, LEAF, SLICE = 12, 6, 64, 512
MAX_ROUNDS, AUDIT_QUERIES, RECALL = 6, 1_024, 0.995
BLOCK, SIDE = 512, 4_096


def _matrix(column: pa.Array, kind=np.float32) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that neither tiny nor huge components leave the range of doubles."""
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _column(group: pa.Table, name: str) -> np.ndarray:
    return group.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def _vectors(group: pa.Table, name: str = "x", kind=np.float32) -> np.ndarray:
    column = group.column(name).combine_chunks()
    return _matrix(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, kind)


def _leaf_lists(vectors: DataFrame, n: int, width: int, k: int, seed: int) -> DataFrame:
    """First lists (u, v, sim) from the leaves of random projections; crowded leaves are sliced by a hash."""
    bits = max(1, int(np.ceil(np.log2(max(2, n / LEAF)))))
    planes = np.random.default_rng(seed).standard_normal((TREES, bits, width)).astype(np.float32)
    powers = 1 << np.arange(bits, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            leaf = np.array([((x @ p.T > 0) * powers).sum(axis=1) + (t << 40) for t, p in enumerate(planes)]).T
            ids = np.repeat(batch.column(0).to_numpy(), TREES)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(leaf.ravel())], names=["id", "leaf"])

    leaves = table(vectors.select("id", "x").mapInArrow(run, "id long, leaf long"), "leaves")
    crowd = leaves.groupBy("leaf").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
    sliced = leaves.join(crowd, "leaf").withColumn("slice", F.pmod(F.xxhash64("id", "leaf"), F.col("slices")).cast("int"))
    rows = sliced.join(vectors.select("id", "width", "x"), "id").select("leaf", "slice", "width", "id", "x")

    def work(group: pa.Table) -> list[np.ndarray]:
        ids, x = _column(group, "id"), _vectors(group)
        us, vs, sims = [], [], []
        for a in range(0, len(ids), BLOCK):
            s = x[a : a + BLOCK] @ x.T
            s[np.arange(len(s)), np.arange(a, a + len(s))] = -2
            m = min(k, len(ids) - 1)
            if m < 1:
                break
            best = np.argpartition(-s, m - 1, axis=1)[:, :m]
            us.append(np.repeat(ids[a : a + BLOCK], m)), vs.append(ids[best].ravel()), sims.append(np.take_along_axis(s, best, 1).ravel())
        if not us:
            return [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)]
        return [np.concatenate(us), np.concatenate(vs), np.concatenate(sims).astype(np.float32)]

    return per_group(rows, ["leaf", "slice", "width"], "u long, v long, sim float", work)


def _best(lists: DataFrame, k: int) -> DataFrame:
    once = lists.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    order = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
    return once.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).drop("r")


def _round(lists: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Neighbours of each vector, in either direction, meet each other; better ones enter their lists."""
    both = lists.select(F.col("u").alias("c"), F.col("v").alias("m"), "sim", "fresh").unionByName(lists.select(F.col("v").alias("c"), F.col("u").alias("m"), "sim", "fresh"))
    order = Window.partitionBy("c").orderBy(F.desc("sim"), "m")
    near = both.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= 2 * k).drop("r", "sim")
    worst = lists.groupBy("u").agg(F.min("sim").alias("low"), F.count("*").alias("n"))
    worst = worst.select(F.col("u").alias("id"), F.when(F.col("n") >= k, F.col("low")).otherwise(F.lit(-2.0)).cast("float").alias("low"))
    known = vectors.select("id", "x").join(worst, "id", "left").select(F.col("id").alias("m"), "x", F.coalesce("low", F.lit(-2.0).cast("float")).alias("low"))

    def work(group: pa.Table) -> list[np.ndarray]:
        ids, at = np.unique(_column(group, "m"), return_index=True)
        fresh, low, x = _column(group, "fresh")[at], _column(group, "low")[at], _vectors(group)[at]
        s = x @ x.T
        good = (fresh[:, None] | fresh) & (s > low[:, None])
        np.fill_diagonal(good, False)
        i, j = np.nonzero(good)
        return [ids[i], ids[j], s[i, j].astype(np.float32)]

    met = per_group(near.join(known, "m").select("c", "m", "fresh", "low", "x"), ["c"], "u long, v long, sim float", work)
    old = lists.withColumn("fresh", F.lit(False))
    return table(_best(old.unionByName(met.withColumn("fresh", F.lit(True))), k), "lists")


def _links(lists: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """Pairs a < b of the lists at or above the threshold, in double precision."""
    near = lists.filter(F.col("sim") >= threshold - 1e-4).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    wide = near.join(vectors.select(F.col("id").alias("a"), F.col("raw").alias("p")), "a").join(vectors.select(F.col("id").alias("b"), F.col("raw").alias("q")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = (_unit(_matrix(batch.column(2), np.float64)) * _unit(_matrix(batch.column(3), np.float64))).sum(axis=1) >= threshold
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return table(wide.select("a", "b", "p", "q").mapInArrow(run, "a long, b long"), "vector-links")


def _audit(vectors: DataFrame, links: DataFrame, crowded: DataFrame, threshold: float, queries: int) -> tuple[int, int, float]:
    """(links found, links there, mean share by query) of a bounded set of vectors that are not crowded against all vectors, in blocks."""
    chosen = vectors.join(crowded, "id", "left_anti").select("id", "raw", "width").orderBy(F.xxhash64("id"), "id").limit(queries).toArrow()
    if not chosen.num_rows:
        return 0, 0, 1.0
    ids, sizes = chosen["id"].to_numpy(), chosen["width"].to_numpy()
    q = _unit(_matrix(chosen["raw"].combine_chunks(), np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4 * BLOCK):
                part = batch.slice(a, 4 * BLOCK)
                i, j = np.nonzero(_unit(_matrix(part.column(1), np.float64)) @ q.T >= threshold)
                other = part.column(0).to_numpy()[i]
                own = (other != ids[j]) & (part.column(2).to_numpy()[i] == sizes[j])
                yield pa.RecordBatch.from_arrays([pa.array(ids[j][own]), pa.array(other[own])], names=["u", "v"])

    there = vectors.select("id", "raw", "width").mapInArrow(run, "u long, v long").select("u", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
    known = there.join(links.withColumn("found", F.lit(1)), ["a", "b"], "left").groupBy("u").agg(F.count("found").alias("found"), F.count("*").alias("there"))
    row = known.agg(F.sum("found").alias("found"), F.sum("there").alias("there"), F.avg(F.col("found") / F.col("there")).alias("mean")).first()
    return row["found"] or 0, row["there"] or 0, 1.0 if row["mean"] is None else row["mean"]


def _joined(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(component, smallest component that links of this block lead to) of rows and columns, where they differ."""
    i, j = near.any(axis=1), near.any(axis=0)
    near, left, right = near[np.ix_(i, j)], left[i], right[j]
    if not len(left) or (left.min() == left.max() == right.min() == right.max()):
        return left[:0], left[:0]
    p, q, high = left, right, np.iinfo(np.int64).max
    while True:
        lower = np.minimum(p, np.where(near, q, high).min(axis=1))
        then = np.minimum(q, np.where(near, lower[:, None], high).min(axis=0))
        if (lower == p).all() and (then == q).all():
            break
        p, q = lower, then
    own, to = np.concatenate([left, right]), np.concatenate([p, q])
    return own[own != to], to[own != to]


def _balls(members: DataFrame) -> DataFrame:
    """component, width, n, centre, radius (an angle) of each component; its members lie in the ball."""
    middle = members.groupBy("component").agg(F.min_by("raw", F.struct(F.xxhash64("id"), "id")).alias("centre"), F.count("*").alias("n"))
    placed = hot_split_join(members.select("component", "id", "width", "raw"), middle, ["component"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (_unit(_matrix(batch.column(c), np.float64)) for c in (0, 1))
            away = 2 * np.arcsin(np.minimum(np.linalg.norm(x - y, axis=1) / 2, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(away)], names=["component", "width", "away"])

    away = placed.select("raw", "centre", "component", "width").mapInArrow(run, "component long, width int, away double")
    radius = away.groupBy("component").agg(F.max("away").alias("radius"), F.max("width").alias("width"))
    return table(middle.join(radius, "component"), "balls")


def _meetings(balls: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a <= b: components whose balls can hold linked vectors, each with itself too."""
    blocks = -(-balls.count() // SIDE) or 1
    placed = balls.withColumn("block", F.pmod(F.xxhash64("component"), F.lit(blocks)).cast("int"))
    cells = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    cells = cells.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "component", "width", "radius", "centre")
    reach = float(np.arccos(threshold)) + 1e-6  # a margin for rounding

    def work(group: pa.Table) -> list[np.ndarray]:
        ids, size, radius, block = (_column(group, c) for c in ("component", "width", "radius", "block"))
        x = _unit(_vectors(group, "centre", np.float64))
        one = group["i"][0].as_py() == group["j"][0].as_py()
        first = np.flatnonzero(block == group["i"][0].as_py())
        second = first if one else np.flatnonzero(block == group["j"][0].as_py())
        left, right = [ids[:0]], [ids[:0]]
        for a in range(0, len(first), BLOCK):
            own = first[a : a + BLOCK]
            limit = np.cos(np.minimum(reach + radius[own][:, None] + radius[second], np.pi))
            near = (x[own] @ x[second].T >= limit - 1e-9) & (size[own][:, None] == size[second])
            if one:
                near &= ids[own][:, None] < ids[second]
            i, j = np.nonzero(near)
            left.append(ids[own[i]]), right.append(ids[second[j]])
        left, right = np.concatenate(left), np.concatenate(right)
        return [np.minimum(left, right), np.maximum(left, right)]

    met = per_group(cells, ["i", "j"], "a long, b long", work)
    return met.unionByName(balls.select(F.col("component").alias("a"), F.col("component").alias("b")))


def _compared(members: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(id, links) and (a, b): linked members of each member, weighted by their copies, and components that links join.

    The members of components that can meet do so in blocks of SIDE x SIDE; no pairs come out.
    """
    balls = _balls(members)
    sizes = balls.select("component", F.ceil(F.col("n") / SIDE).cast("int").alias("blocks"))
    pairs = _meetings(balls, threshold)
    pairs = pairs.join(sizes.toDF("a", "a_blocks"), "a").join(sizes.toDF("b", "b_blocks"), "b")
    pairs = pairs.select("a", "b", F.explode(F.sequence(F.lit(0), F.col("a_blocks") - 1)).alias("i"), "a_blocks", "b_blocks")
    pairs = pairs.select("a", "b", "i", F.explode(F.sequence(F.when(F.col("a") == F.col("b"), F.col("i")).otherwise(0), F.col("b_blocks") - 1)).alias("j"))
    pairs = table(pairs, "meetings")
    ends = pairs.select("a", "b", "i", "j", F.col("a").alias("component"), F.col("i").alias("block"), F.lit(True).alias("first"))
    others = pairs.filter("a <> b or i <> j").select("a", "b", "i", "j", F.col("b").alias("component"), F.col("j").alias("block"), F.lit(False).alias("first"))
    in_block = members.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    cells = ends.unionByName(others).join(in_block.select("component", "block", "id", "weight", "raw"), ["component", "block"])
    cells = cells.select("a", "b", "i", "j", "component", "first", "id", "weight", "raw")

    def work(group: pa.Table) -> list[np.ndarray]:
        ids, weight, home, is_first = (_column(group, c) for c in ("id", "weight", "component", "first"))
        x = _unit(_vectors(group, "raw", np.float64))
        one = group["a"][0].as_py() == group["b"][0].as_py() and group["i"][0].as_py() == group["j"][0].as_py()
        first = np.flatnonzero(is_first)
        second = first if one else np.flatnonzero(~is_first)
        links, ends, to = np.zeros(len(ids), np.int64), [], []
        for a in range(0, len(first), BLOCK):
            own = first[a : a + BLOCK]
            for b in range(0, len(second), BLOCK):
                other = second[b : b + BLOCK]
                near = x[own] @ x[other].T >= threshold
                if one:
                    near &= own[:, None] != other
                else:
                    links[other] += weight[own] @ near
                links[own] += near @ weight[other]
                for held, new in zip((ends, to), _joined(near, home[own], home[other]), strict=True):
                    held.append(new)
        joined = np.unique(np.array([np.concatenate(ends), np.concatenate(to)]), axis=1) if ends else np.empty((2, 0), np.int64)
        some = links > 0
        return [np.concatenate([ids[some], joined[0]]), np.concatenate([links[some], np.zeros(joined.shape[1], np.int64)]), np.concatenate([ids[some], joined[1]])]

    met = table(per_group(cells, ["a", "b", "i", "j"], "id long, links long, to long", work), "compared")
    counts = met.filter("links > 0").groupBy("id").agg(F.sum("links").alias("links"))
    return counts, met.filter("links = 0").select(F.col("id").alias("a"), F.col("to").alias("b")).distinct()


def _whole(vectors: DataFrame, parts: DataFrame, threshold: float) -> DataFrame:
    """(id, links, component) of all vectors by comparing the components that links have made so far, exactly."""
    members = vectors.join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    members = table(members.select("component", "id", "weight", "width", "raw"), "members")
    counts, joined = _compared(members, threshold)
    wider = components(joined).select(F.col("id").alias("component"), F.col("component").alias("wide"))
    out = members.select("id", "component").join(wider, "component", "left").join(counts, "id", "left")
    return out.select("id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("wide", "component").alias("component"))


def _linked(classes: DataFrame, width: int, n: int, threshold: float, k: int) -> tuple[DataFrame, int, int]:
    """(id, links, component) of classes of equal vectors, and what the audit found."""

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit(_matrix(batch.column(3), np.float64)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(x), pa.list_(pa.float32()))], names=["id", "weight", "width", "raw", "x"])

    padded = F.concat("raw", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("raw"))).alias("raw")
    given = classes.select("id", "weight", F.size("raw").alias("width"), padded)
    vectors = table(given.mapInArrow(unit, "id long, weight long, width int, raw array<double>, x array<float>"), "vectors")
    lists = table(_best(_leaf_lists(vectors, n, width, k, seed=3).withColumn("fresh", F.lit(True)), k), "lists")
    for turn in range(1, MAX_ROUNDS + 1):
        lists = _round(lists, vectors, k)
        changed = lists.filter("fresh").count()
        if turn > 1 and (changed <= 0.02 * n * k or turn == MAX_ROUNDS):
            links = _links(lists, vectors, threshold)
            full = lists.filter(F.col("sim") >= threshold - 1e-4).groupBy("u").agg(F.count("*").alias("n")).filter(F.col("n") >= k).select(F.col("u").alias("id"))
            parts = table(components(links), "vector-components")
            crowded = parts.join(full, "id").select("component").distinct()
            crowded = table(parts.join(crowded, "component", "left_semi"), "crowded")
            found, there, mean = _audit(vectors, links, crowded, threshold, AUDIT_QUERIES)
            if found >= RECALL * there and mean >= RECALL:
                break
            if turn < MAX_ROUNDS:
                k += -(-k // 2)
                more = _leaf_lists(vectors, n, width, k, seed=3 + turn)
                lists = table(_best(lists.unionByName(more.withColumn("fresh", F.lit(True))).withColumn("fresh", F.lit(True)), k), "lists")
    else:  # the audit never held
        return table(_whole(vectors, parts, threshold), "vector-classes"), there, there
    members = table(vectors.join(crowded, "id").select("component", "id", "weight", "width", "raw"), "crowded-vectors")
    exact, joined = _compared(members, threshold)
    wider = components(joined).select(F.col("id").alias("component"), F.col("component").alias("wide"))
    parts = parts.join(wider, "component", "left").select("id", F.coalesce("wide", "component").alias("component"))
    ends = links.select(F.col("a").alias("id"), F.col("b").alias("o")).unionByName(links.select(F.col("b").alias("id"), F.col("a").alias("o")))
    plain = ends.join(crowded, "id", "left_anti").join(vectors.select(F.col("id").alias("o"), "weight"), "o").groupBy("id").agg(F.sum("weight").alias("links"))
    counts = exact.unionByName(plain)
    out = vectors.select("id").join(counts, "id", "left").join(parts, "id", "left").select("id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "id").alias("component"))
    return table(out, "vector-classes"), found, there


def near_duplicates(embeddings: DataFrame, threshold: float = 0.95, neighbours: int = NEIGHBOURS) -> DataFrame:
    """vec_id, n_links, component_id, kept, audit_recall of every vector.

    n_links counts the other vectors at or above the threshold, component_id is the smallest vec_id reachable over links.
    """
    vec = F.col("embedding").cast("array<double>")
    finite = ~F.exists(vec, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = F.coalesce(F.col("vec_id").isNotNull() & (F.size(vec) > 0) & finite & F.exists(vec, lambda v: v != 0), F.lit(False))
    plain = F.transform(vec, lambda v: v + F.lit(0.0))  # one zero only
    raw = F.when(good, plain)
    key = F.sha2(F.concat_ws(",", raw.cast("array<string>")), 256)
    rows = table(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), raw.alias("raw"), F.when(good, key).alias("key")), "embeddings")
    own = rows.filter("raw is not null").select("vec_id", "raw", "key")
    classes = own.groupBy("key").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"), F.any_value("raw").alias("raw"))
    classes = table(classes.withColumn("id", F.monotonically_increasing_id()), "vector-keys")
    lone = rows.filter("raw is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    seen = classes.agg(F.max(F.size("raw")).alias("width"), F.count("*").alias("n")).first()
    out, found, there = lone, 0, 0
    if seen["n"]:
        parts, found, there = _linked(classes, seen["width"], seen["n"], threshold, neighbours)
        known = classes.select("id", "key", "first", "weight").join(parts, "id")
        smallest = known.groupBy("component").agg(F.min("first").alias("component_id"))
        known = known.join(smallest, "component").select("key", (F.col("weight") - 1 + F.col("links")).alias("n_links"), "component_id")
        out = own.select("vec_id", "key").join(known, "key").select("vec_id", "n_links", "component_id").unionByName(lone)
    recall = found / there if there else 1.0
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"), F.lit(recall).alias("audit_recall"))
