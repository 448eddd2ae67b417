"""Helpers that the corpus operators share: text buffers, word hashes, shared tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywell.session import materialise

#: Bytes of text that one numpy step works on; a single longer text is one step of its own.
STEP_BYTES = 1 << 20
#: [\x20\x09-\x0D] separate words.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def seeds(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit numbers."""
    return mix(np.arange(n, dtype=np.uint64) + np.uint64(seed) * np.uint64(1_000_003))


_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE_CODE = seeds(256, 11)[_LOWER]
IS_SPACE = np.isin(np.arange(256), SPACES)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the borders of its rows; a null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    border = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[border[0] : border[-1]], border - border[0]


def steps(batch: pa.RecordBatch, column: str, step_bytes: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most so many bytes of text, and one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    total, begin = np.cumsum(sizes.astype(np.int64)), 0
    while begin < len(sizes):
        done = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, done + step_bytes, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def word_hashes(data: np.ndarray, border: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, A-Z in lower case, and the row that the word is in."""
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    inside = ~IS_SPACE[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    first = border[:-1]
    before[first[first < n]] = False
    last = border[1:] - 1
    after[last[last >= 0]] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_CODE[data] * _powers(_BASE, n)[:n], out=total[1:])
    size = (end - start).astype(np.uint64)
    hashed = mix((total[end] - total[start]) * _powers(_BASE_INVERSE, n)[start] + size * _GOLD)
    return hashed, np.searchsorted(border, start, side="right") - 1


def shingle_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """The distinct word shingles of each row as sorted 64-bit hashes.

    A text with fewer words is one shingle of all of them; one without words has none.
    """
    data, border = flat_bytes(column)
    hashed, row = word_hashes(data, border)
    factor = seeds(words + 1, 23) | np.uint64(1)
    counts = np.bincount(row, minlength=len(column))
    starts = np.concatenate([[0], np.cumsum(counts)])
    m = len(hashed) - words + 1
    full = np.zeros(max(m, 0), np.uint64)
    for j in range(words if m > 0 else 0):
        full += hashed[j : j + m] * factor[j]
    full = mix(full + np.uint64(words))
    out = []
    for i, count in enumerate(counts):
        begin = starts[i]
        if count >= words:
            own = np.sort(full[begin : begin + count - words + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif count:
            short = (hashed[begin : begin + count] * factor[:count]).sum(dtype=np.uint64)
            out.append(mix(np.array([short + np.uint64(count)], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def table(df: DataFrame, name: str) -> DataFrame:
    """Write a result to the shared folder and go on from what was written."""
    return materialise(df, name)


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each value of the first columns, which are sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.array([batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)])
        cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            now = tuple(key[:, a])
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            last = now
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def per_group(df: DataFrame, keys: list[str], schema: str, work: Callable[[pa.Table], list[np.ndarray]], then: tuple[str, ...] = ()) -> DataFrame:
    """Columns that work() gives for the rows of each key; only one group is held at a time."""
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[list[np.ndarray]] = []
        size = 0
        for group in groups(batches, len(keys)):
            out = work(group.combine_chunks())
            waiting.append(out)
            size += len(out[0])
            if size > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*waiting, strict=True)], names=names)
                waiting, size = [], 0
        if waiting:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*waiting, strict=True)], names=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *then).mapInArrow(run, schema)
