import random
from collections import Counter

import numpy as np
import pytest

from tallywell.llm import nn_descent, sketch_dedup
from tallywell.llm.components import components

from .conftest import prose


def shingles(text, k):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def smallest(ids, pairs):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def groups_slowly(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    pairs = [(a, b) for x, (a, s) in enumerate(sets) for b, t in sets[:x] if s and t and 100 * len(s & t) >= percent * len(s | t)]
    return smallest({i for i, _ in sets}, pairs)


def test_sketches_estimate_similarity():
    draw = np.random.default_rng(5)
    items = draw.integers(0, 2**63, 900, dtype=np.uint64)
    for shared in (300, 600):
        a, b = np.unique(items[:600]), np.unique(items[600 - shared : 1200 - shared])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        s = sketch_dedup.fast_sketches([a, b, a[:3]], 512)
        assert abs((s[0] == s[1]).mean() - true) < 0.1
        assert (s != np.iinfo(np.uint64).max).all()  # every bin is filled, of tiny sets too
    assert sketch_dedup.fast_sketches([], 8).shape == (0, 8)


def test_common_counts():
    draw = np.random.default_rng(6)
    left = [np.unique(draw.integers(0, 60, 30)).astype(np.uint64) for _ in range(5)] + [np.empty(0, np.uint64)]
    right = [np.unique(draw.integers(0, 60, 30)).astype(np.uint64) for _ in range(4)]
    want = [[len(np.intersect1d(a, b)) for b in right] for a in left]
    assert sketch_dedup.common_counts(left, right, columns=7).tolist() == want


def test_components(spark):
    draw = random.Random(7)
    pairs = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    rows = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    ids = {x for a, b in pairs if a != b for x in (a, b)}
    assert {r.id: r.component for r in rows} == smallest(ids, [(a, b) for a, b in pairs if a != b])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("words", [2, 5])
def test_near_copies_of_odd_rows(odd_docs, odd_texts, no_docs, words):
    rows = [(i, t) for i, t, *_ in odd_texts]
    want = groups_slowly(rows, words, 80)
    out = sketch_dedup.near_duplicates(odd_docs, words).collect()
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out)
    assert got == Counter((i, len(shingles(t, words)), want.get(i), i is None or want[i] == i) for i, t in rows)
    if words == 5:
        kept = sketch_dedup.first_of_each(odd_docs, words)
        assert kept.columns == odd_docs.columns
        assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, _ in set(rows) if i is None or want[i] == i)
        assert sketch_dedup.near_duplicates(no_docs).count() == 0


def test_large_group_of_near_copies(spark, monkeypatch):
    """Chains and loose members of one group, through heads, small buckets and blocks."""
    monkeypatch.setattr(sketch_dedup, "BLOCK", 16)
    monkeypatch.setattr(sketch_dedup, "HEAD_PAIRS", 7)
    draw = random.Random(8)
    base, rows = prose(20, 90).split(), []
    for i in range(150):
        own = list(base)
        for _ in range(draw.randint(0, 12)):
            own[draw.randrange(len(own))] = f"edit{draw.randrange(40)}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, prose(100 + i, 60)) for i in range(100)]
    out = {r.doc_id: r.component_id for r in sketch_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()}
    assert out == groups_slowly(rows, 2, 80)


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "BLOCK", 32)
    monkeypatch.setattr(nn_descent, "SLICE", 64)
    draw = np.random.default_rng(9)
    centres = draw.standard_normal((6, 16))
    vectors = [list(map(float, centres[i % 6] + 0.8 * draw.standard_normal(16))) for i in range(300)]
    vectors += [list(map(float, np.array(vectors[i % 5]) + 0.1 * draw.standard_normal(16))) for i in range(60)]
    vectors += [vectors[7]] * 20 + [[2 * x for x in vectors[8]]]
    rows = list(enumerate(vectors))
    n = len(rows)
    rows += [(4, vectors[9]), (4, vectors[10]), (n, vectors[11])]  # one id on several vectors
    rows += [(n, None), (n + 1, []), (n + 2, [0.0] * 16), (n + 3, [float("nan")] * 16), (n + 4, [None] + [1.0] * 15), (n + 5, [float("inf")] * 16), (n + 6, [1.0, 2.0]), (n + 7, [1.0, 2.1]), (None, vectors[0]), (3, vectors[3])]
    df = spark.createDataFrame([(i, v, 1, "x", 1.0) for i, v in rows], "vec_id long, embedding array<double>, label int, key string, weight double").repartition(5)
    out = nn_descent.near_duplicates(df).collect()
    good = [(at, i, np.array(v) / np.linalg.norm(v)) for at, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = [(a, b) for x, (a, _, p) in enumerate(good) for y, (b, _, q) in enumerate(good) if x != y and len(p) == len(q) and float(p @ q) >= 0.95]
    degree, root = Counter(a for a, _ in links), smallest(range(len(rows)), links)
    first = {}
    for at, i, _ in good:
        first[root[at]] = min(first.get(root[at], i), i)
    want = Counter()
    for at, (i, _) in enumerate(rows):
        to = first.get(root[at], i)
        want[i, degree[at], to, i is None or to == i] += 1
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in out) == want
    assert {r.audit_recall for r in out} == {1.0}
    assert nn_descent.near_duplicates(df.limit(0)).count() == 0


def links_slowly(vectors):
    x = np.array(vectors) / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    root = smallest(range(len(x)), np.argwhere(near).tolist())
    return {i: (int(near[i].sum()), root[i]) for i in range(len(x))}


def in_rows(spark, vectors):
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    return df.repartition(3)


@pytest.mark.parametrize("rounds", [2, 8])
def test_links_that_the_first_lists_miss(spark, monkeypatch, rounds):
    """A sparse start: further rounds with new leaves, or all pairs in blocks, bring the rest."""
    for name, value in {"TREES": 1, "LEAF": 1, "BLOCK": 32, "SIDE": 100, "MAX_ROUNDS": rounds}.items():
        monkeypatch.setattr(nn_descent, name, value, raising=False)
    draw = np.random.default_rng(10)
    centres = draw.standard_normal((130, 32))
    vectors = [centres[i % 130] + 0.12 * draw.standard_normal(32) for i in range(390)]
    out = nn_descent.near_duplicates(in_rows(spark, vectors), neighbours=2).collect()
    want = links_slowly(vectors)
    assert sum(n for n, _ in want.values()) > 500
    missed = sum(abs(r.n_links - want[r.vec_id][0]) for r in out)
    assert missed <= 0.01 * sum(n for n, _ in want.values())
    assert {r.audit_recall for r in out} <= {1.0} or rounds > 2
    if rounds == 2:
        assert {r.vec_id: (r.n_links, r.component_id) for r in out} == want


def test_links_that_a_large_group_hides(spark, monkeypatch):
    """Two tight groups that fill their own lists, beside a group with nearly all links."""
    for name, value in {"BLOCK": 64, "SIDE": 150}.items():
        monkeypatch.setattr(nn_descent, name, value, raising=False)
    draw = np.random.default_rng(12)
    vectors = [c for c in draw.standard_normal(32) + 0.1 * draw.standard_normal((500, 32))]
    centre, aside = draw.standard_normal(32), draw.standard_normal(32)
    for tight in (centre, centre + 0.29 * aside):
        vectors += [c for c in tight + 0.01 * draw.standard_normal((14, 32))]
    vectors += [c + 0.12 * draw.standard_normal(32) for c in draw.standard_normal((60, 32)) for _ in range(2)]
    out = nn_descent.near_duplicates(in_rows(spark, vectors), neighbours=10).collect()
    want = links_slowly(vectors)
    assert want[500][0] == 27
    assert {r.vec_id: (r.n_links, r.component_id) for r in out} == want


def as_members(df, width):
    return df.selectExpr("vec_id id", "vec_id component", "1L weight", f"{width} width", "cast(embedding as array<double>) raw")


def test_crowded_groups_are_not_compared_all_with_all(spark, monkeypatch):
    """Groups larger than the lists: the component pairs that meet grow with the vectors, not with their square."""
    meetings = {}
    for groups in (100, 2000):
        draw = np.random.default_rng(13)
        vectors = [c + 0.02 * draw.standard_normal(32) for c in draw.standard_normal((groups, 32)) for _ in range(20)]
        if groups == 100:
            out = nn_descent.near_duplicates(in_rows(spark, vectors), neighbours=6).collect()
            assert {r.vec_id: (r.n_links, r.component_id) for r in out} == links_slowly(vectors)
        members = as_members(in_rows(spark, vectors), 32).selectExpr("id", "id div 20 component", "weight", "width", "raw")
        meetings[groups] = nn_descent._meetings(nn_descent._balls(members), 0.95).count()
    assert meetings[100] >= 100 and meetings[2000] < 1.05 * 20 * meetings[100]  # each group with itself and hardly another


@pytest.mark.parametrize("group", [1, 7, 200])
def test_balls_lose_no_link(spark, monkeypatch, group):
    """Vectors without any grouping, in components of any radius, over several blocks."""
    for name, value in {"SIDE": 16, "BLOCK": 8}.items():
        monkeypatch.setattr(nn_descent, name, value)
    draw = np.random.default_rng(14)
    vectors = [draw.standard_normal(3) for _ in range(150)]
    members = as_members(in_rows(spark, vectors), 3)
    parts = members.selectExpr("id", f"id div {group} * {group} component")
    got = {r.id: r.links for r in nn_descent._whole(members.drop("component"), parts, 0.95).collect()}
    want = links_slowly(vectors)
    assert got == {i: n for i, (n, _) in want.items()}
    if group == 1:
        assert {r.id: r.component for r in nn_descent._whole(members.drop("component"), parts, 0.95).collect()} == {i: c for i, (_, c) in want.items()}
