"""A quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are counted with numpy over the bytes of many texts at a time: shares of byte classes, entropy, word and line
shapes, repetition. The trees are fitted on a bounded sample of labelled rows (MAX_TRAIN, those with the smallest hash of
their id, so the choice depends on neither order nor partitioning) and flattened into arrays: all rows walk all trees at
once. Every text is scored whole.

Defined cases: a null text is an empty one and gets a score like any other; of repeated labels of an id the smallest
counts; null labels are no labels; without labels of both kinds the score is the share of label 1, or 0.5 if there are
none; a null doc_id counts as held out. Labels, lang, source and doc_id are no inputs of a score. Further columns are
not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywell.llm.common import IS_SPACE, flat_bytes, steps, word_hashes

#: Rows the trees are fitted on, at most.
MAX_TRAIN = 20_000
HOLD_OUT = 5
THRESHOLD = 0.3
BINS = 64

_BYTES = np.arange(256)
_CLASSES = {
    "upper": (_BYTES >= 65) & (_BYTES <= 90),
    "lower": (_BYTES >= 97) & (_BYTES <= 122),
    "digit": (_BYTES >= 48) & (_BYTES <= 57),
    "wide": _BYTES >= 128,
    "blank": np.isin(_BYTES, (9, 32)),
    "line": _BYTES == 10,
    "stop": np.isin(_BYTES, [ord(c) for c in ".,;:?"]),
    "bang": _BYTES == ord("!"),
    "pipe": np.isin(_BYTES, [ord(c) for c in "|<>{}[]\\/_="]),
    "sign": np.isin(_BYTES, [ord(c) for c in "#$%&*@^~+"]),
    "quote": np.isin(_BYTES, [ord(c) for c in "\"'`()-"]),
    "control": _BYTES < 32,
}
_CLASS_MATRIX = np.array(list(_CLASSES.values()), np.float64).T
FEATURES = [*_CLASSES, "log_bytes", "entropy", "top_byte", "log_words", "word_bytes", "distinct_words", "top_word", "doubled_words", "distinct_pairs", "lines", "line_bytes", "distinct_lines"]


def _shares(key: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: number of keys, share of distinct ones, share of the most frequent one."""
    count = np.bincount(row, minlength=n).astype(float)
    order = np.lexsort((key, row))
    k, r = key[order], row[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    most = np.zeros(n)
    np.maximum.at(most, r[at], np.diff(np.append(at, len(k))))
    some = np.maximum(count, 1)
    return count, np.bincount(r[at], minlength=n) / some, most / some


def statistics(column: pa.Array) -> np.ndarray:
    """The FEATURES of each text, one row per text."""
    data, border = flat_bytes(column)
    n, size = len(column), np.diff(border).astype(float)
    if not n:
        return np.empty((0, len(FEATURES)))
    row = np.repeat(np.arange(n), np.diff(border))
    counts = np.bincount(row * 256 + data, minlength=n * 256).reshape(n, 256)
    some = np.maximum(size, 1)[:, None]
    share = counts / some
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
    hashed, owner = word_hashes(data, border)
    words, distinct, top = _shares(hashed, owner, n)
    inner = owner[1:] == owner[:-1] if len(owner) else np.empty(0, bool)
    doubled = np.bincount(owner[1:][inner & (hashed[1:] == hashed[:-1])], minlength=n) / np.maximum(words, 1)
    pairs = hashed[:-1][inner] * np.uint64(3) + hashed[1:][inner]
    _, distinct_pairs, _ = _shares(pairs, owner[1:][inner], n)
    # a line is the sum of its words' hashes by place
    line_of_byte = np.cumsum(data == 10)
    starts = np.concatenate([[0], line_of_byte])[border[:-1]]
    ends = np.concatenate([[0], line_of_byte])[border[1:]]
    lines = ends - starts + 1.0
    nth = _word_lines(data, border, line_of_byte)
    line_key, line_row = _line_hashes(hashed, owner, nth)
    filled, distinct_lines, _ = _shares(line_key, line_row, n)
    letters = size - counts[:, [32, 9, 10, 11, 12, 13]].sum(axis=1)
    rest = [np.log1p(size), entropy, share.max(axis=1), np.log1p(words), letters / np.maximum(words, 1), distinct, top, doubled, distinct_pairs, np.log1p(lines), np.log1p(letters / np.maximum(filled, 1)), distinct_lines]
    return np.hstack([counts @ _CLASS_MATRIX / some, np.array(rest).T])


def _word_lines(data: np.ndarray, border: np.ndarray, line_of_byte: np.ndarray) -> np.ndarray:
    """The line that each word of word_hashes() is in."""
    inside = ~IS_SPACE[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    first = border[:-1]
    before[first[first < len(data)]] = False
    return line_of_byte[np.flatnonzero(inside & ~before)]


def _line_hashes(hashed: np.ndarray, owner: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(hashed):
        return hashed, owner
    new = np.ones(len(hashed), bool)
    new[1:] = (line[1:] != line[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    place = np.arange(len(hashed)) - np.repeat(at, np.diff(np.append(at, len(hashed))))
    return np.add.reduceat(hashed * (2 * place.astype(np.uint64) + np.uint64(1)), at), owner[at]


@dataclass
class Trees:
    """All trees in flat arrays; a leaf points to itself."""

    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if len(self.roots):
            node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
            rows = np.arange(len(x))[:, None]
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.limit[node], self.left[node], self.right[node])
            total = total + self.value[node].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 5, rate: float = 0.15, least: int = 10, ridge: float = 1.0) -> Trees:
    """Logistic boosting on histograms of at most BINS quantile bins per feature, grown level by level."""
    share = y.mean() if len(y) else 0.5
    if share in (0.0, 1.0) or not len(y):
        share = min(max(share, 1e-6), 1 - 1e-6)
        none = np.empty(0, np.int64)
        return Trees(none, none.astype(float), none, none, none.astype(float), none, 0, float(np.log(share / (1 - share))))
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    binned = np.array([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)]).T
    base = float(np.log(share / (1 - share)))
    total = np.full(n, base)
    feature, limit, left, right, value, roots = [], [], [], [], [], []

    def node(v: float) -> int:
        feature.append(0), limit.append(np.inf), left.append(len(left)), right.append(len(right)), value.append(v)
        return len(value) - 1

    cell = np.arange(width) * BINS
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        roots.append(node(rate * g.sum() / (h.sum() + ridge)))
        at = np.full(n, roots[-1])
        live = [roots[-1]]
        for _ in range(depth):
            if not live:
                break
            place = {v: i for i, v in enumerate(live)}
            slot = np.full(len(value), -1)
            slot[live] = np.arange(len(live))
            s = slot[at]
            own = s >= 0
            key = (s[own, None] * (width * BINS) + cell + binned[own]).ravel()
            shape, many = (len(live), width, BINS), len(live) * width * BINS
            sums = [np.bincount(key, np.repeat(v[own], width), many).reshape(shape).cumsum(axis=2) for v in (g, h, np.ones(n))]
            lg, lh, ln = sums
            tg, th, tn = (v[:, :, -1:] for v in sums)
            gain = lg**2 / (lh + ridge) + (tg - lg) ** 2 / (th - lh + ridge) - tg**2 / (th + ridge)
            gain[(ln < least) | (tn - ln < least)] = -1
            for j, c in enumerate(cuts):
                gain[:, j, len(c) :] = -1
            best = gain.reshape(len(live), -1).argmax(axis=1)
            following = []
            for v, i in place.items():
                j, b = divmod(int(best[i]), BINS)
                if gain[i, j, b] <= 1e-9:
                    continue
                feature[v], limit[v] = j, float(cuts[j][b])
                left[v] = node(rate * lg[i, j, b] / (lh[i, j, b] + ridge))
                right[v] = node(rate * (tg[i, j, 0] - lg[i, j, b]) / (th[i, j, 0] - lh[i, j, b] + ridge))
                mine = np.flatnonzero(at == v)
                at[mine] = np.where(binned[mine, j] <= b, left[v], right[v])
                following += [left[v], right[v]]
            live = following
        total = total + np.array(value)[at]
    return Trees(*(np.array(v) for v in (feature, limit, left, right, value, roots)), depth, base)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit(""))) % HOLD_OUT == 0


def fitted(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, label: str = "quality") -> Trees:
    """Trees learnt from at most max_train labelled documents that are not held out, one row for each id."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("known_id")).agg(F.min(label).cast("int").alias("y"))
    sample = known.orderBy(F.xxhash64("known_id"), "known_id").limit(max_train)  # bounded, so it may be broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("known_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "known_id")
    rows = rows.groupBy("known_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))  # the smallest text of a repeated id

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                x = statistics(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(list(x), pa.list_(pa.float64()))], names=["known_id", "y", "x"])

    out = rows.select("known_id", "text", "y").mapInArrow(run, "known_id long, y int, x array<double>").toArrow()
    x = np.array(out["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    y, ids = out["y"].to_numpy().astype(float), out["known_id"].to_numpy()
    order = np.lexsort((*x.T, y, ids))
    return fit(x[order], y[order])


def scored(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(trees.scores(statistics(part.column(1))), pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with a score of at least the threshold, all columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                texts = part.column(part.schema.get_field_index("text")).cast(pa.string())
                yield part.filter(pa.array(trees.scores(statistics(texts)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
