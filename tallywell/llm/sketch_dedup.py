"""Near-duplicates by fast similarity sketching, banding and exact verification.

Rounds of hashed bin placement: in round i < t every shingle falls into one
random bin with the value (i, hash); in round t + j every shingle falls into
bin j. A bin keeps its smallest value, and a document is ready once all its t
bins are filled, which round 2t guarantees. The share of equal bins estimates
the Jaccard similarity with the concentration of t independent samples.

Bands of bins find candidates; a link is confirmed on the full shingle sets.
With 32 bands of 6 bins, two documents at a similarity of 0.8 share no band
with a probability of 6e-5, at 0.9 of 1e-10.

Groups: texts with equal shingle sets are one class from the start. Each class first meets one head, the most central
class of its buckets. What is then still apart in a bucket is compared with the bucket's other components, in blocks that
give links only. So near copies of each other never give all their pairs, and no link between different components is
left untested.

Defined cases: a null text is an empty one; texts without words have no
shingles and link with nothing; a null doc_id links with nothing, has a null
component and is kept. Repeated rows are one document; where one doc_id has several texts, each row is classed by its own
and the smallest text stands for the id in near comparisons. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywell.llm.common import mix, per_group, seeds, shingle_sets, steps, table
from tallywell.llm.components import components
from tallywell.plans.skew import is_small

BANDS, ROWS = 32, 6
SKETCH = "doc_id long, n_shingles long, digest binary, bands array<long>"
#: Pairs that a small bucket gives at most; larger ones are compared in blocks of BLOCK x BLOCK classes.
FEW_TESTS, BLOCK = 256, 256
#: Pairs of one head that one task verifies.
HEAD_PAIRS = 2_000


def fast_sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """Sketches of t bins, one row per set; sets must not be empty."""
    n = len(sets)
    out = np.full((n, t), np.iinfo(np.uint64).max, np.uint64)
    if not n:
        return out
    flat = out.reshape(-1)
    items = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    seed, low = seeds(2 * t, 37), np.uint64(0xFFFFFFFF)
    for i in range(2 * t):
        x = mix(items ^ seed[i])
        bin_of = ((x >> np.uint64(32)) % np.uint64(t)).astype(np.int64) if i < t else i - t
        np.minimum.at(flat, owner * t + bin_of, (np.uint64(i) << np.uint64(32)) | (x & low))
        full = (out != np.iinfo(np.uint64).max).all(axis=1)
        if full.all():
            break
        left = ~full[owner]
        items, owner = items[left], owner[left]
    return out


def band_keys(sketches: np.ndarray, bands: int, rows: int) -> np.ndarray:
    factor = seeds(rows, 41) | np.uint64(1)
    cells = mix(sketches.reshape(len(sketches), bands, rows))
    return mix((cells * factor).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)).view(np.int64)


def sketched(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, size of the shingle set, its digest, and one key per band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                sets = shingle_sets(part.column(1), words)
                some = [s for s in sets if len(s)]
                keys = iter(band_keys(fast_sketches(some, bands * rows), bands, rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).cast(pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "digest", "bands"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SKETCH)


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are at least that similar.

    Texts travel once per pair, beside one copy of the head's text for every HEAD_PAIRS pairs of it.
    """
    sized = pairs.join(pairs.groupBy("a").agg(F.ceil(F.count("*") / HEAD_PAIRS).cast("int").alias("slices")), "a")
    sized = sized.withColumn("slice", F.pmod(F.xxhash64("b"), F.col("slices")).cast("int"))
    heads = sized.select("a", "slice").distinct().join(texts, F.col("a") == F.col("rep")).select("a", "slice", F.lit(None).cast("long").alias("b"), "text")
    members = sized.join(texts, F.col("b") == F.col("rep")).select("a", "slice", "b", "text")
    dealt = heads.unionByName(members).repartition("a", "slice").sortWithinPartitions("a", "slice", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.empty(0, np.uint64)
        for batch in batches:
            for part in steps(batch, "text"):
                sets, found = shingle_sets(part.column(3), words), []
                for a, b, own in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), sets, strict=True):
                    if b is None:
                        head = own
                        continue
                    small, large = sorted((len(own), len(head)))
                    if 100 * small < percent * large:
                        continue
                    at = np.searchsorted(head, own)
                    same = int((head[np.minimum(at, len(head) - 1)] == own).sum()) if len(head) else 0
                    if 100 * same >= percent * (len(own) + len(head) - same):
                        found.append((a, b))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _crowded(cells: DataFrame) -> DataFrame:
    """key, rep, n, central of the buckets with several classes; a class is as central as its buckets are full."""
    sizes = cells.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    full = cells.join(sizes, "key")
    return full.join(full.groupBy("rep").agg(F.sum("size").alias("central")), "rep").select("key", "rep", "n", "central")


def _partners(shared: DataFrame) -> DataFrame:
    """(a, b): for each class the most central class of its buckets, the one it shares most of them with."""
    top = shared.groupBy("key").agg(F.max(F.struct("central", (-F.col("rep")).alias("minus"))).alias("h")).select("key", (-F.col("h.minus")).alias("a"))
    met = shared.join(top, "key").filter("a != rep").groupBy("rep", "a").agg(F.count("*").alias("times"))
    best = met.groupBy("rep").agg(F.max(F.struct("times", (-F.col("a")).alias("minus"))).alias("h"))
    return best.select((-F.col("h.minus")).alias("a"), F.col("rep").alias("b"))


def _mixed(shared: DataFrame, parts: DataFrame) -> DataFrame:
    """The buckets that still hold several components, with each class's component and the bucket's largest one."""
    marked = shared.join(parts, F.col("rep") == F.col("id"), "left").select("key", "rep", "n", "central", F.coalesce("component", "rep").alias("part"))
    sizes = marked.groupBy("key", "part").agg(F.count("*").alias("size"))
    main = sizes.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("size", "part")).alias("m"), F.sum("size").alias("size"))
    main = main.filter("parts > 1").select("key", F.col("m.part").alias("main"), (F.col("size") * (F.col("size") - F.col("m.size"))).alias("tests"))
    return marked.join(main, "key")


def _rest(mixed: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between different components that share a bucket, beyond those with a head.

    Small buckets give their pairs, at most FEW_TESTS each. Of the others, those with the same main component are
    one group: the classes outside of it are compared with all of the group, block by block, and only links come out.
    """
    small = mixed.filter(F.col("tests") <= FEW_TESTS)
    strange = small.filter("part != main").select("key", F.col("rep").alias("r"), F.col("n").alias("m"), F.col("part").alias("p"))
    close = (F.col("p") != F.col("part")) & (100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
    pairs = strange.join(small, "key").filter(close).select(F.least("r", "rep").alias("a"), F.greatest("r", "rep").alias("b")).distinct()
    links = confirmed(table(pairs, "few-pairs"), texts, words, percent)
    large = table(mixed.filter(F.col("tests") > FEW_TESTS).select("main", "rep", "part").distinct(), "crowds")
    sizes = large.groupBy("main").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("wide"), F.ceil(F.count(F.when(F.col("part") != F.col("main"), 1)) / BLOCK).cast("int").alias("deep"))
    placed, slot = large.join(sizes, "main"), F.xxhash64("rep", "main")
    asking = placed.filter("part != main").select("main", F.pmod(slot, F.col("deep")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("wide") - 1)).alias("j"), F.lit(0).alias("side"), "rep", "part")
    asked = placed.select("main", F.explode(F.sequence(F.lit(0), F.col("deep") - 1)).alias("i"), F.pmod(slot, F.col("wide")).cast("int").alias("j"), F.lit(1).alias("side"), "rep", "part")
    cells = asking.unionByName(asked).join(texts, "rep").select("main", "i", "j", "side", "rep", "part", "text")

    def work(group: pa.Table) -> list[np.ndarray]:
        side, rep, part = (group.column(c).to_numpy() for c in ("side", "rep", "part"))
        rows = group.select(["text"]).to_batches()
        sets = [s for batch in rows for step in steps(batch, "text") for s in shingle_sets(step.column(0), words)]
        size = np.array([len(s) for s in sets])
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = common_counts([sets[k] for k in left], [sets[k] for k in right])
        linked = (100 * same >= percent * (size[left][:, None] + size[right] - same)) & (part[left][:, None] != part[right])
        x, y = np.nonzero(linked)
        return [np.minimum(rep[left[x]], rep[right[y]]), np.maximum(rep[left[x]], rep[right[y]])]

    return links.unionByName(per_group(cells, ["main", "i", "j"], "a long, b long", work, then=("side",)))


def common_counts(left: list[np.ndarray], right: list[np.ndarray], columns: int = 8_192) -> np.ndarray:
    """Sizes of the intersections of each set on the left with each on the right."""
    out = np.zeros((len(left), len(right)), np.int64)
    if not len(left) or not len(right):
        return out
    values = [np.concatenate(x) for x in (left, right)]
    owners = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    both = np.intersect1d(*(np.unique(v) for v in values), assume_unique=True)
    places = [np.searchsorted(both, v) for v in values]
    for begin in range(0, len(both), columns):
        there = []
        for v, owner, place, sets in zip(values, owners, places, (left, right), strict=True):
            own = (place >= begin) & (place < min(begin + columns, len(both)))
            own[own] = both[place[own]] == v[own]
            part = np.zeros((len(sets), min(columns, len(both) - begin)), np.float32)
            part[owner[own], place[own] - begin] = 1
            there.append(part)
        out += (there[0] @ there[1].T).astype(np.int64)
    return out


def _by_size(ids: DataFrame) -> DataFrame:
    """Ids to be broadcast if they are counted and few; else the texts are shuffled to them."""
    return F.broadcast(ids) if is_small(ids) else ids


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Two documents link when 100 * intersection >= percent * union of their
    shingle sets; component_id is the smallest doc_id reachable over links.
    """
    all_rows = table(sketched(docs, words, bands, rows), "sketches")
    linked = all_rows.filter("n_shingles > 0 and doc_id is not null")
    # equal sets have equal sizes and bands
    classes = linked.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = table(classes, "classes")
    shared = table(_crowded(classes.select("rep", "n", F.explode("bands").alias("key"))), "shared")
    # each class meets the most central class of its buckets
    first = table(_partners(shared), "first-pairs")
    wanted = _by_size(shared.select("rep").distinct())
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text")).join(wanted, "rep")
    texts = table(texts.groupBy("rep").agg(F.min("text").alias("text")), "texts")
    links = table(confirmed(first, texts, words, percent), "first-links")
    # what is still apart in a bucket meets the bucket's other components
    mixed = table(_mixed(shared, components(links)), "mixed")
    links = table(links.unionByName(_rest(mixed, texts, words, percent)), "links")
    marked = table(components(links), "components")
    of_class = classes.join(marked, F.col("rep") == F.col("id"), "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    plain = all_rows.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = linked.join(of_class, "digest").select("doc_id", "n_shingles", "component_id").unionByName(plain)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def first_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents without the near copies: of each group the smallest doc_id stays, of repeated rows one; all columns are kept."""
    judged = table(near_duplicates(docs, words, percent).select("doc_id", "kept"), "judged")
    gone = _by_size(judged.filter("not kept").select(F.col("doc_id").alias("gone_id")).distinct())
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("own_id"))
    rows = rows.join(gone, F.col("own_id") == F.col("gone_id"), "left_anti")
    again = judged.groupBy(F.col("doc_id").alias("again_id")).agg(F.count("*").alias("times")).filter("times > 1 and again_id is not null")
    again = _by_size(table(again.select("again_id"), "repeated"))
    once = rows.join(again, F.col("own_id") == F.col("again_id"), "left_anti").select("doc")
    several = rows.join(again, F.col("own_id") == F.col("again_id"), "left_semi")
    one = several.groupBy("own_id", "doc.text").agg(F.min_by("doc", F.to_json("doc")).alias("doc")).select("doc")
    return once.unionByName(one).select("doc.*")
