import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallywell.llm import packing, sharding, telephony
from tallywell.llm.common import mix


def test_telephony_round_trip(odd_docs, odd_texts, no_docs):
    rows = telephony.transcoded(odd_docs, keep=("media", "pcm")).collect()
    assert len(rows) == len(odd_texts)
    expected = Counter((i, hashlib.sha256(telephony.padded((t or "").encode())).hexdigest()) for i, t, *_ in odd_texts)
    assert Counter((r.doc_id, r.payload_sha256) for r in rows) == expected
    for r in rows:
        tag, rate, data = telephony.load(bytes(r.media))
        payload = telephony.payload_of(tag, data)
        assert hashlib.sha256(payload).hexdigest() == r.payload_sha256 and zlib.crc32(payload[-16:]) == r.tail_crc32
        assert (len(payload), len(r.media), hashlib.sha256(bytes(r.media)).hexdigest(), rate) == (r.payload_bytes, r.media_bytes, r.media_sha256, 8000)
        assert f"pcm_crc32={zlib.crc32(bytes(r.pcm))}" in r.feature
    assert len({r.feature.split(";")[0] for r in rows}) == 3  # all codecs
    assert len({r.feature for r in rows if r.n_bytes == 0}) == 1  # equal texts, equal values
    assert telephony.transcoded(no_docs).count() == 0


def test_g711_tables():
    # values of ITU-T G.711: the largest and the smallest steps
    assert [int(telephony.TABLES[7][c]) for c in (0x00, 0x80, 0xFF, 0x7F, 0x8F)] == [-32124, 32124, 0, 0, 16764]
    assert [int(telephony.TABLES[6][c]) for c in (0xD5, 0x55, 0xAA, 0x2A)] == [8, -8, 32256, -32256]


def adpcm_slowly(block: bytes) -> list[int]:
    now, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [now]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(telephony.STEP_SIZES[index])
            move = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            now = max(-32768, min(32767, now - move if code & 8 else now + move))
            index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[code & 7]))
            out.append(now)
    return out


def test_adpcm_against_one_block_at_a_time():
    blocks = np.random.default_rng(1).integers(0, 256, (7, telephony.BLOCK), dtype=np.uint8)
    got = telephony.adpcm_blocks(blocks)
    assert [list(map(int, x)) for x in got] == [adpcm_slowly(b.tobytes()) for b in blocks]


def test_resampled_tone_stays_a_tone():
    t = np.arange(800)
    tone = (8000 * np.sin(2 * np.pi * 440 * t / 8000)).astype(np.int16)
    twice = telephony.doubled(tone)
    want = 8000 * np.sin(2 * np.pi * 440 * np.arange(1600) / 16000)
    assert (twice[0::2] == tone).all() and np.abs(twice[20:-20] - want[20:-20]).max() < 120


def jump_slowly(key: int, shards: int) -> int:
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash():
    ids = np.arange(-50, 2000, dtype=np.int64)
    keys = mix(ids.view(np.uint64))
    for shards in (1, 2, 40, 41):
        assert sharding.jump_hash(keys, shards).tolist() == [jump_slowly(int(k), shards) for k in keys]
    a, b = sharding.jump_hash(keys, 40), sharding.jump_hash(keys, 41)
    assert set(b[a != b]) == {40} and 20 < (a != b).sum() < 90
    assert np.bincount(a, minlength=40).min() > 20


def test_shards_of_one_id_and_of_copies(spark, monkeypatch):
    """An id on most rows is cut into buckets, and the copies of one row are written in runs; slots stay gapless."""
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 100)
    monkeypatch.setattr(sharding, "RUN", 64)
    ids = spark.range(3_000).selectExpr("7L AS doc_id", "concat('text ', id) AS text")
    copies = spark.range(2_000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "'same' AS text")
    others = spark.range(1_000).selectExpr("id AS doc_id", "CAST(NULL AS STRING) AS text")
    out = sharding.sharded(ids.unionByName(copies).unionByName(others), 4)
    rows = out.collect()
    assert len(rows) == 6_000 and len({(r.shard, r.slot) for r in rows}) == 6_000
    for shard in range(4):
        slots = [r.slot for r in rows if r.shard == shard]
        assert sorted(slots) == list(range(len(slots)))
    assert {r.shard for r in rows if r.doc_id == 7} == {jump_slowly(int(mix(np.array([7], np.uint64))[0]), 4)}
    assert sum(r.doc_id is None for r in rows) == 2_000


def test_shards(odd_docs, odd_texts, no_docs, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 1)  # several buckets per shard
    rows = sharding.sharded(odd_docs, 4).collect()
    expected = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in odd_texts)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == expected
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        key = int(mix(np.array([-1 if r.doc_id is None else r.doc_id], np.int64).view(np.uint64))[0])
        assert (r.shard, r.grown_shard, r.law) == (jump_slowly(key, 4), jump_slowly(key, 5), "key")
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.sharded(no_docs).count() == 0


def check_packing(rows, capacity):
    at = defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(at)


def test_packing(odd_docs, odd_texts, no_docs):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = Counter()
    for i, t, *_ in odd_texts:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        expected.update((i, k, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())) for k, (start, n) in enumerate(packing.cut(len(ids), 2048)))
    added = [(500, "<|endoftext|> x"), (501, "x  y<|endoftext|>")]
    for i, t in added:
        ids = plain.encode(t, add_special_tokens=False).ids + [0]
        assert 50256 in ids
        expected[i, 0, 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    docs = odd_docs.select("doc_id", "text").unionByName(odd_docs.sparkSession.createDataFrame(added, "doc_id long, text string"))
    rows = packing.packed(docs).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    total = sum(r.length for r in rows)
    assert check_packing(rows, 2048) == -(-total // 2048)
    assert packing.packed(no_docs).count() == 0


def test_tokens_of_uneven_texts():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", " ", "\n", " a", "a ", "a\nb c\n", "it's we'll don't", "a  b", "a\n\nb", "x\ty", "a \nb", "\n a", "12 34, ok!\nNo. 5", "a b c", "<|endoftext|> x", "x\x00y z", " a b", "é è\nê"]
    for text in texts:
        assert np.frombuffer(packing.token_bytes(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("choose", ["norm", "dot"])
def test_best_fit_holds_every_capacity(choose):
    draw = np.random.default_rng(3)
    counts = dict(Counter(draw.integers(1, 101, 3000).tolist()))
    plan = packing.best_fit(counts, 100, max_documents=5, max_cost=6000 if choose == "norm" else 10_000, weights=(1.0, 0.2, 0.2), choose=choose) if choose == "dot" else packing.best_fit(counts, 100, max_documents=5)
    bins, seen = defaultdict(list), Counter()
    for length, lo, hi, base, each, fill in plan.tolist():
        for rank in range(lo, hi):
            bins[base + (rank - lo) // each].append((fill + length * ((rank - lo) % each), length))
            seen[length] += 1
    assert seen == Counter(counts)
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 100 and len(places) <= 5
        assert sum(n * n for _, n in places) <= 10_000
    bound = -(-sum(k * n for k, n in counts.items()) // 100)
    assert len(bins) <= bound * 1.25
    with pytest.raises(ValueError):
        packing.best_fit({60: 1}, 100, max_cost=3000)


def test_weights_choose_other_bins():
    """The same capacities, some of which bind, filled otherwise when documents and cost weigh too."""
    draw = np.random.default_rng(4)
    counts = dict(Counter(draw.integers(1, 40, 600).tolist()))
    held = {}
    for choose in ("norm", "dot"):
        for w in ((1.0, 0.0, 0.0), (1.0, 1.0, 1.0)):
            plan = packing.best_fit(counts, 100, max_documents=5, max_cost=2500, weights=w, choose=choose)
            bins = defaultdict(list)
            for length, lo, hi, base, each, _ in plan.tolist():
                for rank in range(lo, hi):
                    bins[base + (rank - lo) // each].append(length)
            assert all(sum(b) <= 100 and len(b) <= 5 and sum(n * n for n in b) <= 2500 for b in bins.values())
            assert any(len(b) == 5 and sum(b) < 100 for b in bins.values())  # the document capacity binds
            held[choose, w] = sorted(map(tuple, map(sorted, bins.values())))
    assert held["norm", (1.0, 1.0, 1.0)] != held["norm", (1.0, 0.0, 0.0)]
    assert held["dot", (1.0, 1.0, 1.0)] != held["dot", (1.0, 0.0, 0.0)]


def test_packing_under_all_capacities(odd_docs):
    rows = packing.packed(odd_docs, capacity=512, max_documents=4, max_cost=150_000, longest=256).collect()
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        assert len(places) <= 4 and sum(n * n for _, n in places) <= 150_000
    assert check_packing(rows, 512) == len(bins) and max(r.length for r in rows) == 256
    assert any(len(p) == 4 for p in bins.values()) and any(sum(n * n for _, n in p) > 150_000 - 256**2 for p in bins.values())
