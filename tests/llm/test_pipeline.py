from collections import Counter, defaultdict

import corpus_pipeline
from tallywell.llm import boosting

from .conftest import prose
from .test_media_shards_packing import check_packing
from .test_near_copies import groups_slowly


def test_stages_against_brute_force(spark, tmp_path, odd_docs, odd_texts):
    rows = [(100 + i, prose(30 + i, 80), "en", f"src{i % 20}", 1) for i in range(40)]
    rows += [(200 + i, rows[i][1] + " added", "en", "src0", 1) for i in range(10)]
    rows += [(300 + i, " ".join(w + "%%%" for w in prose(70 + i, 60).split()), "en", "src1", 1) for i in range(15)]
    rows += [(400, f"{prose(90, 40)} token = 0123456789abcdef0123456789abcdef {prose(91, 20)}", "fr", "src2", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(odd_docs.select(*docs.columns))
    labels = spark.createDataFrame([(i, int(not 300 <= i < 400)) for i, *_ in rows], "doc_id long, quality int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    sf, states = str(tmp_path), [spark.read.parquet(f"{tmp_path}/documents.parquet")]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_copies", "secrets", "mixture", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, states[-1], sf).write.parquet(f"{tmp_path}/{name}")
        states.append(spark.read.parquet(f"{tmp_path}/{name}"))
    given, good, single, clean, mixed, packed = states
    assert all(s.columns == given.columns for s in (good, single, clean, mixed))

    scores = boosting.scored(given, boosting.fitted(given, labels)).filter("predicted = 1").select("doc_id")
    assert Counter(r.doc_id for r in good.select("doc_id").collect()) == Counter(r.doc_id for r in scores.collect())
    ids = {r.doc_id for r in good.select("doc_id").collect()}
    assert not ids & set(range(300, 315)) and set(range(100, 140)) <= ids

    have = [(r.doc_id, r.text) for r in good.collect()]
    root = groups_slowly(have, 5, 80)
    assert Counter(r.doc_id for r in single.collect()) == Counter(i for i, _ in set(have) if i is None or root[i] == i)

    before, after = {r.doc_id: r.text for r in single.collect()}, {r.doc_id: r.text for r in clean.collect()}
    assert before.keys() == after.keys()
    assert [i for i in before if before[i] != after[i]] == [400] and "0123456789" not in after[400] and "[secret]" in after[400]

    times = Counter(r.doc_id for r in mixed.collect())
    assert set(times) <= set(after) and max(times.values()) <= 2  # two epochs at most
    pieces = packed.collect()
    assert Counter(r.doc_id for r in pieces if r.piece == 0) == times
    check_packing(pieces, corpus_pipeline.SEQUENCE_TOKENS)
    places = defaultdict(list)
    for r in pieces:
        places[r.sequence_id].append(r.length)
    for lengths in places.values():
        assert len(lengths) <= corpus_pipeline.SEQUENCE_DOCUMENTS and sum(n * n for n in lengths) <= corpus_pipeline.SEQUENCE_COST
    assert max(r.length for r in pieces) <= corpus_pipeline.PIECE_TOKENS
