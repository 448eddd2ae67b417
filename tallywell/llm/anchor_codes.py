"""Product codes of vectors, with codebooks refined over metric trees made by the anchors hierarchy.

Vectors are dealt into blocks; in a block every part position gets a tree of balls, built middle-out: about sqrt(n)
anchors take the points nearest to them, each anchor is split further in the same way, and the anchors are merged pair by
pair, the smallest ball first. A ball keeps its centre, radius, and the sum and count of its points. A round walks all trees
from their roots with the list of entries that may still be nearest; a ball drops an entry when another one is nearer for
every point that the ball can hold, and hands the shorter list down. A ball left with one entry is owned as a whole and
adds its cached sum and count; only points of leaves with several entries are compared one by one. Coordinates,
sums and comparisons of points are whole numbers, and dropping leaves a margin for rounding, so codes are exact.

Blocks are built once and written to the shared folder with their trees; rounds read them again, so a lost executor costs
its tasks only. Between rounds the driver holds the codebooks: entries x components, whatever the number of vectors.

Defined cases: vectors that are null or hold a null or non-finite component are left out; a shorter vector counts as
padded with zeros to the longest length, which is rounded up to a whole number of parts. The codebooks start from the rows
with the smallest vec_ids (null ids last, equal ids by vector), fewer where there are fewer rows. Equal rows and ties are
ordinary; null labels are one label. Components so large that a squared distance may not fit in 63 bits are refused with a
ValueError. An empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywell.llm.common import table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Points of a ball that is not split further.
LEAF = 64
#: A block holds at most so many rows, and so many whole numbers.
BLOCK_ROWS, BLOCK_VALUES = 4096, 1 << 18


class Tree(NamedTuple):
    """Balls of a set of points, which stand in an order that makes each ball a range; the root is ball 0."""

    points: np.ndarray  # int32 [n, width]
    order: np.ndarray  # int32 [n]: the row that each point is of
    low: np.ndarray  # int32 [balls]
    high: np.ndarray
    left: np.ndarray  # child balls, -1 for a leaf
    right: np.ndarray
    centre: np.ndarray  # int64 [balls, width]
    radius: np.ndarray  # float64 [balls]
    total: np.ndarray  # int64 [balls, width]


def _lengths(difference: np.ndarray) -> np.ndarray:
    return np.sqrt((difference.astype(np.float64) ** 2).sum(axis=-1))


def anchors(points: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The anchor that owns each point, and the points that are anchors.

    Each new anchor is the point farthest from its owner. Points that lie within half the distance between
    their owner and the new anchor cannot change hands and are not measured.
    """
    owner, pivots = np.zeros(len(points), np.int64), [0]
    far = _lengths(points - points[0])
    while len(pivots) < np.ceil(np.sqrt(len(points))):
        new = int(far.argmax())
        if far[new] == 0:
            break
        between = _lengths(points[pivots] - points[new])
        may = np.flatnonzero(2 * far > between[owner])
        near = _lengths(points[may] - points[new])
        stolen = near < far[may]
        owner[may[stolen]], far[may[stolen]] = len(pivots), near[stolen]
        pivots.append(new)
    return owner, pivots


class _Ball:
    __slots__ = ("centre", "children", "count", "radius", "rows")

    def __init__(self, centre: np.ndarray, radius: float, count: int, rows: np.ndarray | None, children: tuple = ()):
        self.centre, self.radius, self.count, self.rows, self.children = centre, radius, count, rows, children


def _merged(balls: list[_Ball]) -> _Ball:
    """One ball over all, made from pairs, those that need the smallest ball first."""
    centre = np.array([b.centre for b in balls], np.float64)
    radius = np.array([b.radius for b in balls])
    alive = np.ones(len(balls), bool)

    def need(i: int) -> np.ndarray:
        away = _lengths(centre - centre[i])
        out = np.maximum(np.maximum(radius, radius[i]), (away + radius + radius[i]) / 2)
        out[~alive] = np.inf
        out[i] = np.inf
        return out

    cost = np.array([need(i) for i in range(len(balls))])
    balls = list(balls)
    for _ in range(len(balls) - 1):
        i, j = divmod(int(cost.argmin()), len(balls))
        a, b = balls[i], balls[j]
        count = a.count + b.count
        middle = (a.centre * a.count + b.centre * b.count) / count
        reach = max(_lengths(middle - a.centre) + a.radius, _lengths(middle - b.centre) + b.radius)
        balls[i] = _Ball(middle, float(reach), count, None, (a, b))
        alive[j], centre[i], radius[i] = False, middle, reach
        cost[j, :] = cost[:, j] = np.inf
        cost[i, :] = cost[:, i] = need(i)
    return balls[int(np.flatnonzero(alive)[0])]


def _grown(points: np.ndarray, rows: np.ndarray) -> _Ball:
    own = points[rows]
    if len(rows) > LEAF:
        owner, pivots = anchors(own)
        if len(pivots) > 1:
            return _merged([_grown(points, rows[owner == k]) for k in range(len(pivots))])
    middle = own.mean(axis=0)
    return _Ball(middle, float(_lengths(own - middle).max()), len(rows), rows)


def tree_of(points: np.ndarray) -> Tree:
    """The metric tree of whole-number points."""
    root = _grown(points, np.arange(len(points)))
    order, low, high, left, right = [], [], [], [], []
    at = 0
    todo: list[tuple[_Ball, int, bool]] = [(root, -1, False)]
    while todo:  # balls in pre-order: a ball's points follow those of the balls before it
        ball, parent, second = todo.pop()
        own = len(low)
        if parent >= 0:
            (right if second else left)[parent] = own
        low.append(at)
        high.append(at + ball.count)
        left.append(-1)
        right.append(-1)
        if ball.children:
            todo += [(ball.children[1], own, True), (ball.children[0], own, False)]
        else:
            order.append(ball.rows)
            at += ball.count
    placed = np.concatenate(order)
    points = points[placed].astype(np.int64)
    sums = np.vstack([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points, axis=0)])
    total = sums[high] - sums[low]
    centre = total // (np.array(high) - np.array(low))[:, None]
    radius = np.array([_lengths(points[a:b] - c).max() for a, b, c in zip(low, high, centre, strict=True)])
    short = [np.array(x, np.int32) for x in (low, high, left, right)]
    return Tree(points.astype(np.int32), placed.astype(np.int32), *short, centre, radius * (1 + 1e-12), total)


def packed(tree: Tree) -> bytes:
    head = np.array([len(tree.order), tree.points.shape[1], len(tree.low)], np.int64)
    return b"".join([head.tobytes(), *(np.ascontiguousarray(x).tobytes() for x in tree)])


def unpacked(data: bytes) -> Tree:
    n, width, balls = np.frombuffer(data, np.int64, 3).tolist()
    shapes = [(n, width), (n,), *[(balls,)] * 4, (balls, width), (balls,), (balls, width)]
    kinds = [np.int32] * 6 + [np.int64, np.float64, np.int64]
    out, at = [], 24
    for shape, kind in zip(shapes, kinds, strict=True):
        size = int(np.prod(shape))
        out.append(np.frombuffer(data, kind, size, at).reshape(shape))
        at += size * np.dtype(kind).itemsize
    return Tree(*out)


def _distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    return ((points[:, None, :].astype(np.int64) - entries) ** 2).sum(axis=2)


def assigned(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The nearest entry of each point (ties: the first), sums and counts by entry, and the points compared one by one."""
    never = np.iinfo(np.int64).max
    code = np.empty(len(tree.order), np.int8 if len(entries) <= 127 else np.int32)
    sums, counts = np.zeros(entries.shape, np.int64), np.zeros(len(entries), np.int64)
    apart = _lengths(entries[:, None, :] - entries)
    first = np.array([not (entries[:i] == e).all(axis=1).any() for i, e in enumerate(entries)])  # of equal entries the first wins
    balls, may = np.zeros(1, np.int64), first[None, :]
    leaves, lists = [], []
    while len(balls):
        away = np.where(may, _distances(tree.centre[balls], entries), never)
        best = away.argmin(axis=1)
        rows = np.arange(len(balls))
        lead = away.astype(np.float64) - away[rows, best][:, None]
        reach = tree.radius[balls][:, None]
        may = may & (lead <= 2 * reach * apart[best] * (1 + 1e-9)) & (reach > 0)
        may[rows, best] = True
        owned = may.sum(axis=1) == 1
        for ball, entry in zip(balls[owned], best[owned], strict=True):
            code[tree.low[ball] : tree.high[ball]] = entry
            sums[entry] += tree.total[ball]
            counts[entry] += tree.high[ball] - tree.low[ball]
        leaf = ~owned & (tree.left[balls] < 0)
        leaves.append(balls[leaf])
        lists.append(may[leaf])
        down = ~owned & ~leaf
        balls, may = np.concatenate([tree.left[balls[down]], tree.right[balls[down]]]), np.concatenate([may[down]] * 2)
    leaf, may = np.concatenate(leaves), np.concatenate(lists)
    size = tree.high[leaf] - tree.low[leaf]
    at = np.repeat(tree.low[leaf] - np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)[: len(size)], size) + np.arange(size.sum())
    if len(at):
        points = tree.points[at]
        near = np.where(np.repeat(may, size, axis=0), _distances(points, entries), never).argmin(axis=1)
        code[at] = near
        np.add.at(sums, near, points.astype(np.int64))
        counts += np.bincount(near, minlength=len(entries))
    return code, sums, counts, len(at)


def whole_numbers(column: pa.Array, width: int, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of a list column, rows padded with zeros to the width."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, label and vector (doubles) of the rows whose vectors are whole and finite."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("vector"))
    endless = (F.lit(float("inf")), F.lit(float("-inf")))
    return rows.filter(F.col("vector").isNotNull()).filter(~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | x.isin(*endless)))


def blocks(rows: DataFrame, width: int, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """ids, labels and one tree per part position of every block."""
    most = max(1, min(BLOCK_ROWS, BLOCK_VALUES // max(width, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def block() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            numbers = whole_numbers(rows.column("vector").combine_chunks(), width, scale)
            trees = [packed(tree_of(part)) for part in np.split(numbers, parts, axis=1)]
            ends = pa.array([0, len(rows)], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, rows.column(c).combine_chunks()) for c in ("vec_id", "label")]
            return pa.RecordBatch.from_arrays([*lists, pa.array([trees], pa.list_(pa.binary()))], names=["ids", "labels", "trees"])

        for batch in batches:
            while batch.num_rows:
                take = min(batch.num_rows, most - count)
                held.append(batch.slice(0, take))
                batch, count = batch.slice(take), count + take
                if count == most:
                    yield block()
                    held, count = [], 0
        if count:
            yield block()

    kinds = rows.schema
    schema = T.StructType(
        [T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("labels", T.ArrayType(kinds["label"].dataType)), T.StructField("trees", T.ArrayType(T.BinaryType()))]
    )
    return rows.mapInArrow(run, schema)


def refined(forest: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks [parts, entries, width] after one round over all blocks; an entry that no part is nearest to stays."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for trees in batch.column(0):
                for part, tree in enumerate(trees):
                    _, own, seen, _ = assigned(unpacked(tree.as_py()), books[part])
                    sums[part] += own
                    counts[part] += seen
        slot = np.arange(parts * entries)
        values = np.concatenate([counts.reshape(-1, 1), sums.reshape(len(slot), width)], axis=1)
        ends = pa.array(np.arange(len(slot) + 1) * (width + 1), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.ListArray.from_arrays(ends, pa.array(values.ravel()))], names=["slot", "values"])

    given = forest.select("trees").mapInArrow(run, "slot long, values array<long>").select("slot", F.posexplode("values").alias("place", "value"))
    sums = given.groupBy("slot", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).filter("value <> 0")
    total = np.zeros((parts * entries, width + 1), object)
    for row in sums.collect():  # entries x (components + 1) rows at most
        total[row["slot"], row["place"]] = int(row["value"])
    total = total.reshape(parts, entries, width + 1)
    out = books.copy()
    for part, entry in np.argwhere(total[:, :, 0] > 0):
        out[part, entry] = total[part, entry, 1:] // total[part, entry, 0]
    return out


def _checked_width(rows: DataFrame, parts: int, scale: int) -> int:
    """The common length of the vectors; refuses components whose distances may not fit in 63 bits."""
    seen = rows.agg(F.max(F.size("vector")).alias("size"), F.max(F.array_max(F.transform("vector", F.abs))).alias("most")).first()
    width = -(-(seen["size"] or 0) // parts) * parts
    most = 2 * (scale * (seen["most"] or 0.0) + 1)
    if most >= 2**31 or width * most**2 >= 2**63:
        raise ValueError(f"components up to {seen['most']} are too large for whole-number distances")
    return width


def coded(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every usable vector."""
    rows = usable(embeddings)
    width = _checked_width(rows, parts, scale)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    start = whole_numbers(pa.array([r["vector"] for r in first], pa.list_(pa.float64())), width, scale)
    books = np.stack(np.split(start, parts, axis=1))
    forest = table(blocks(rows, width, parts, scale), "anchor-blocks")
    for _ in range(rounds if len(first) else 0):
        books = refined(forest, books)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels = (batch.column(c)[i].values for c in (0, 1))
                codes, error = np.empty((len(ids), parts), np.int64), np.zeros(len(ids), np.int64)
                for part, data in enumerate(batch.column(2)[i]):
                    tree = unpacked(data.as_py())
                    code = assigned(tree, books[part])[0]
                    codes[tree.order, part] = code
                    error[tree.order] += ((tree.points.astype(np.int64) - books[part][code]) ** 2).sum(axis=1)
                text = pa.array(["".join(f"{c:02x}" for c in row) for row in codes.tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([ids, labels, text, pa.array(error)], names=["vec_id", "label", "code", "error"])

    shape = T.StructType([*rows.select("vec_id", "label").schema, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    out = table(forest.mapInArrow(run, shape), "anchor-codes")
    by_label = out.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "same_label")
    joined = out.join(by_label, F.col("label").eqNullSafe(F.col("same_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
