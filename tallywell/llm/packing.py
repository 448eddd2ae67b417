"""Vector best-fit packing of documents into sequences.

Documents become token ids; only longer ones are cut. What the packing needs to know of a piece is its length, so the
driver plans on the histogram of lengths (a row per length up to the capacity, whatever the size of the corpus): bins
with equal residuals are one class with a count, lengths go from long to short, and each goes to the class that fits best under every capacity,
tokens, documents and attention cost, by residual norm or weighted dot-product. The plan says which ranks of a length
go to which bins; ranks come from counts by (length, part of the written table), so nothing is numbered in one task.

Ids are those of the vocabulary file, whose added tokens are found in the text before all else; between them the same ranks are
merged by `tiktoken`, which is several times as fast on new words.

Defined cases: a null text is an empty one, which is the end id alone; equal rows are packed one by one; very long texts
become many pieces; an empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywell.llm.common import steps, table

CAPACITY = 2048
END_ID = 0
#: Of the residual tokens, documents and attention cost in the choice of a bin.
WEIGHTS = (1.0, 1.0, 1.0)
#: Words whose ids a Python worker keeps.
KEPT_WORDS = 300_000
#: Texts where blanks and line ends stand alone between words: there each word with its blank is a token group of its own.
_UNEVEN = re.compile(r"\s\s|[^\S \n]|\x00")


class Ids(dict):
    """Token ids, as little-endian bytes, of a word with the blank before it; the vocabulary file's added tokens come first."""

    def __init__(self, ranks_path: str, vocabulary: str):
        import public_tokenizers
        import tiktoken

        with open(vocabulary, encoding="utf-8") as file:
            added = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
        self.added = {text: np.array([i], "<u4").tobytes() for text, i in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KEPT_WORDS:
            self.clear()
        out = np.array(self.encoding.encode_ordinary(word), "<u4").tobytes()
        if len(word) <= 40:
            self[word] = out
        return out

    def of(self, text: str) -> bytes:
        if self.cut and self.cut.search(text):
            return b"".join(self.added[part] if k % 2 else self.plain(part) for k, part in enumerate(self.cut.split(text)))
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        if not text:
            return b""
        if _UNEVEN.search(text):
            return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes()
        words = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        return b"".join(map(self.__getitem__, words))


_IDS: dict[tuple[str, str], Ids] = {}


def default_files() -> tuple[str, str]:
    """The same vocabulary twice: as ranks, and with its added tokens."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


def token_bytes(text: str | None, files: tuple[str, str] | None = None) -> bytes:
    """The ids of a text as little-endian unsigned 32-bit numbers."""
    files = files or default_files()
    if files not in _IDS:
        _IDS[files] = Ids(*files)
    return _IDS[files].of(text or "")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones, and before them the rest."""
    if n <= capacity:
        return [(0, n)]
    rest = n % capacity
    return ([(0, rest)] if rest else []) + [(at, capacity) for at in range(rest, n, capacity)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, files: tuple[str, str] | None = None) -> DataFrame:
    """A row per piece; `part` and `place` number the pieces of one length within one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for step in steps(batch, "text"):
                rows = []
                for doc, text in zip(step.column(0).to_pylist(), step.column(1).to_pylist(), strict=True):
                    ids = memoryview(token_bytes(text, files) + END_ID.to_bytes(4, "little"))
                    for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        rows.append((doc, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), part, int(seen[length])))
                        seen[length] += 1
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(7)], names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, place long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def best_fit(
    counts: dict[int, int],
    capacity: int = CAPACITY,
    max_documents: int | None = None,
    max_cost: int | None = None,
    weights: tuple[float, float, float] = WEIGHTS,
    choose: str = "norm",
) -> np.ndarray:
    """Rows (length, first rank, end rank, first bin, items per bin, fill before) for a histogram of lengths.

    A piece weighs (length, 1, length squared) against the capacities. Of the bins with room in all three, "norm" takes
    the one with the smallest weighted residual after it, "dot" the one whose residual has the largest weighted
    dot-product with the piece. Ties go to the oldest bin.
    """
    limit = np.array([capacity, max_documents or capacity, max_cost or capacity**2], np.int64)
    scale = np.array(weights) / limit.astype(float) ** 2
    if choose not in ("norm", "dot"):
        raise ValueError(choose)
    left, size, base, fill = np.empty((0, 3), np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    out, bins = [], 0
    order = sorted((k for k, n in counts.items() if n), reverse=True)
    for at, length in enumerate(order):
        item, rank, n = np.array([length, 1, length * length], np.int64), 0, counts[length]
        if (item > limit).any():
            raise ValueError(f"a piece of {length} tokens fits into no sequence")
        while n:
            fits = np.flatnonzero((left >= item).all(axis=1))
            if len(fits):
                room = left[fits]
                score = (((room - item).astype(float) ** 2) * scale).sum(axis=1) if choose == "norm" else -((room * item.astype(float)) * scale).sum(axis=1)
                c = fits[np.argmin(score)]
            else:  # open as many new bins as the rest needs
                each = int((limit // item).min())
                new = -(-n // each)
                left, size, base, fill = np.vstack([left, limit]), np.append(size, new), np.append(base, bins), np.append(fill, 0)
                bins, c = bins + new, len(size) - 1
            each = int((left[c] // item).min())
            used = min(int(size[c]), n // each) or 1
            each = min(each, n)
            take = used * each
            out.append((length, rank, rank + take, base[c], each, fill[c]))
            if used < size[c]:  # the rest of the class stays as it is
                left, size = np.vstack([left, left[c]]), np.append(size, size[c] - used)
                base, fill = np.append(base, base[c] + used), np.append(fill, fill[c])
                size[c] = used
            left[c] -= each * item
            fill[c] += each * length
            rank, n = rank + take, n - take
        if at + 1 < len(order):  # bins that not even the shortest piece fits into are closed
            least = np.array([order[-1], 1, order[-1] ** 2])
            stay = (left >= least).all(axis=1)
            left, size, base, fill = left[stay], size[stay], base[stay], fill[stay]
    return np.array(out, np.int64).reshape(-1, 6)


def packed(
    docs: DataFrame,
    capacity: int = CAPACITY,
    max_documents: int | None = None,
    max_cost: int | None = None,
    longest: int | None = None,
    weights: tuple[float, float, float] = WEIGHTS,
    choose: str = "norm",
    files: tuple[str, str] | None = None,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    max_documents and max_cost bound the pieces and the sum of squared lengths of a sequence; by default they are what a
    full sequence can hold at most. Documents beyond `longest` tokens (by default a sequence) are cut.
    """
    cut_up = table(pieces(docs, longest or capacity, files), "pieces")
    counts = table(cut_up.groupBy("length", "part").agg(F.count("*").alias("rows")), "piece-counts")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("rows").alias("n")).collect()}  # at most `capacity` rows
    plan = best_fit(totals, capacity, max_documents, max_cost, weights, choose)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    shift = np.int64(1 << 46)
    begins = plan[:, 0] * shift + plan[:, 1]
    ranked = cut_up.join(first, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("place")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            row = plan[np.searchsorted(begins, length * shift + rank, side="right") - 1] if len(length) else plan[:0]
            nth = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(row[:, 3] + nth // row[:, 4]), pa.array(row[:, 5] + length * (nth % row[:, 4]))],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
