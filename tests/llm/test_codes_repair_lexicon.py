import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tallywell.llm import anchor_codes, lexicon, role_repair

from .conftest import CLASHES, prose


# --- vector codes -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("n", "width", "spread"), [(1, 8, 9000), (5, 8, 9000), (700, 8, 9000), (2000, 8, 300), (300, 1, 9000), (1500, 4, 3), (90, 0, 1)])
def test_trees_find_the_nearest_entries(n, width, spread):
    draw = np.random.default_rng(n)
    points = np.repeat(draw.integers(-9000, 9000, (20, width)), n // 20 + 1, axis=0)[:n] + draw.integers(-spread, spread, (n, width))
    tree = anchor_codes.unpacked(anchor_codes.packed(anchor_codes.tree_of(points)))
    assert sorted(tree.order) == list(range(n)) and (tree.points == points[tree.order]).all()
    for low, high, centre, radius, total in zip(tree.low, tree.high, tree.centre, tree.radius, tree.total, strict=True):
        own = points[tree.order[low:high]]
        assert (own.sum(axis=0) == total).all() and (((own - centre) ** 2).sum(axis=1) <= radius**2 * (1 + 1e-9)).all()
    entries = points[:16].copy()
    entries[len(entries) // 2] = entries[0]  # equal entries: the first wins
    code, sums, counts, compared = anchor_codes.assigned(tree, entries)
    want = ((points[:, None] - entries) ** 2).sum(axis=2).argmin(axis=1)
    got = np.empty(n, int)
    got[tree.order] = code
    assert (got == want).all() and (counts == np.bincount(want, minlength=len(entries))).all()
    assert all((sums[k] == points[want == k].sum(axis=0)).all() for k in range(len(entries)))
    if n == 2000:
        assert compared < n  # whole balls were owned


def codes_slowly(rows, parts=8, entries=16, rounds=6):
    kept = [(i, label, [float(x) for x in v]) for i, label, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, _, v in kept), default=0) // parts) * parts
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    number = [[int(np.floor(4096 * x)) for x in v] + [0] * (width - len(v)) for _, _, v in kept]
    w = width // parts
    split = [[tuple(v[p * w : p * w + w]) for v in number] for p in range(parts)]
    books = [list(s[:entries]) for s in split]

    def nearest(x, book):
        return min(range(len(book)), key=lambda k: (sum((a - b) ** 2 for a, b in zip(x, book[k], strict=True)), k))

    for _ in range(rounds):
        for p in range(parts):
            owned = defaultdict(list)
            for x in split[p]:
                owned[nearest(x, books[p])].append(x)
            for k, own in owned.items():
                books[p][k] = tuple(sum(c) // len(own) for c in zip(*own, strict=True))
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    out, by_label = [], Counter()
    for n, (i, label, _) in enumerate(kept):
        code = [nearest(split[p][n], books[p]) for p in range(parts)]
        error = sum((a - b) ** 2 for p in range(parts) for a, b in zip(split[p][n], books[p][code[p]], strict=True))
        by_label[label] += error
        out.append((i, label, "".join(f"{c:02x}" for c in code), error))
    return Counter((i, code, error, by_label[label], digest) for i, label, code, error in out)


def vectors(draw, n, width, odd=True):
    centres = draw.standard_normal((9, width))
    rows = [(i, [None, 0, 1, 2][i % 4], list(map(float, centres[i % 9] + 0.3 * draw.standard_normal(width)))) for i in range(n)]
    if odd:
        bad = [None, [None] + [1.0] * (width - 1), [float("nan")] * width, [float("-inf")] * width]
        rows += [(n + k, 1, v) for k, v in enumerate(bad)] + [(3, 1, rows[3][2]), (3, 2, [0.0] * width), (None, 0, rows[5][2])]
        rows += [(500 + i, 7, rows[7][2]) for i in range(40)]
    return rows


@pytest.mark.parametrize(("n", "width", "uneven"), [(400, 16, False), (150, 13, True), (9, 8, False)])
def test_codes_against_plain_loops(spark, monkeypatch, n, width, uneven):
    monkeypatch.setattr(anchor_codes, "BLOCK_ROWS", 37)
    monkeypatch.setattr(anchor_codes, "LEAF", 8)
    rows = vectors(np.random.default_rng(n), n, width, odd=n > 9)
    if uneven:
        rows += [(900, 1, []), (901, None, [0.5, -0.5])]
    schema = "vec_id long, label int, embedding array<double>, code string, error string, ids string, slot string, value string, same_label string"
    df = spark.createDataFrame([(*r, *["clash"] * 6) for r in rows], schema).repartition(3)
    out = anchor_codes.coded(df).collect()
    assert Counter(tuple(r) for r in out) == codes_slowly(rows)
    assert [f for f in anchor_codes.coded(df.limit(0)).columns] == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert anchor_codes.coded(df.limit(0)).count() == 0


def test_components_that_no_long_can_hold(spark):
    df = spark.createDataFrame([(1, 0, [1e12] * 8)], "vec_id long, label int, embedding array<double>")
    with pytest.raises(ValueError, match="too large"):
        anchor_codes.coded(df)


# --- conversations ------------------------------------------------------------------------------------------------


def cheapest(codes):
    """Least (cost, audit) by search over (row, place in the grammar) in that very order."""
    go = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    heap, seen = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, row, at = heapq.heappop(heap)
        if row > len(codes):
            return cost, audit
        if (row, at) in seen:
            continue
        seen.add((row, at))
        for role in "ua":
            if (at, role) in go:
                heapq.heappush(heap, (cost + 3, audit + "I", row, go[at, role]))
        if row == len(codes):
            if at in (0, 3):
                heapq.heappush(heap, (cost, audit, row + 1, at))
            continue
        heapq.heappush(heap, (cost + 4, audit + "D", row + 1, at))
        if codes[row] != "-":
            extra = 3 if codes[row].isupper() else 0
            for role, price, edit in [("u", 3, "R"), ("a", 3, "R"), (codes[row].lower(), 0, "K")]:
                if (at, role) in go:
                    heapq.heappush(heap, (cost + price + extra, audit + edit, row + 1, go[at, role]))
    raise AssertionError(codes)


def in_chunks(codes, cuts):
    borders = [0, *cuts, len(codes)]
    parts = [codes[a:b] for a, b in zip(borders, borders[1:], strict=False)]
    cost, audits = role_repair.best_audits([tuple(map(list, zip(*role_repair.chunk_paths(p, True), strict=True))) for p in parts])
    assert [sum(c != "I" for c in a) for a in audits] == [len(p) for p in parts]
    return cost, "".join(audits)


def test_cheapest_edits():
    draw = random.Random(1)
    for _ in range(800):
        codes = "".join(draw.choice("suaSUAxX-uaua") for _ in range(draw.randint(1, 10)))
        want = cheapest(codes)
        assert in_chunks(codes, []) == want
        if len(codes) > 1:
            assert in_chunks(codes, sorted(draw.sample(range(1, len(codes)), draw.randint(1, min(4, len(codes) - 1))))) == want


def test_stacks_are_merged_and_few():
    p = role_repair.parser()
    assert len(p.stacks) == 8 and p.stacks[0] == (0,)
    top = {}
    below = role_repair.Node(0)
    for paid in ((3, "RK"), (3, "KR"), (4, "D")):
        p._link(top, 1, below, paid)
    assert top[1].links == {below: (3, "KR")}
    other = role_repair.Parser(role_repair.GRAMMAR, role_repair.Prices(delete=1, rerole=9, insert=9, truncated=0))
    assert other.accepted(other.read({(0,): (0, "")}, "a", False, False)) == (1, "D")


def hurt(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        what = zlib.crc32(key.encode()) % 20
        if what:
            text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
            out += [(conv, turn, "user" if what == 4 else role, text)] * (2 if what == 3 else 1)
    return out


def in_order(rows):
    digest = lambda r: hashlib.sha256(f"{len(r[2].encode())}:{r[2]}{r[3]}".encode()).hexdigest()
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), digest(r)))


def repair_slowly(ids, rows):
    out, turns_out = {}, {}
    for conv in ids:
        own = in_order([r for r in rows if r[0] == conv])
        seen, codes, faults = set(), "", Counter()
        for _, _, role, text in own:
            solid = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
            codes += "-" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
            faults[fault] += 1
        initials = [r[2][:1] for r in own]
        turns = [r[1] for r in own if r[1] is not None]
        cost, audit = cheapest(codes)
        done, edits, left = [], iter(own), [e for e in audit if e != "D"]
        pairs = -1 if len(left) % 2 else 0
        for edit in audit:
            row = None if edit == "I" else next(edits)
            if edit == "D":
                continue
            role = row[2] if edit == "K" else "ua"[pairs % 2].replace("u", "user").replace("a", "assistant") if pairs >= 0 else None
            done.append((role, "" if edit == "I" else row[3], edit))
            pairs += 1
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, *_ in done))
        text = "\n".join(f"{r}:{t}" for r, t, _ in done)
        turns_out[conv] = done
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out, turns_out


def talk(seed):
    draw = random.Random(seed)
    ends = [".", "!", "?", "", " .\n", ". \t\x0b"]
    rows = []
    for conv in range(60):
        for turn in range(draw.randint(0, 7)):
            role = draw.choice(["user", "assistant"]) if draw.random() < 0.3 else "system" if turn == 0 and draw.random() < 0.5 else ["user", "assistant"][turn % 2]
            rows.append((conv, turn, role, prose(conv * 10 + turn, draw.randint(1, 8)) + draw.choice(ends)))
    rows += [(100, t, ["user", "assistant"][t % 2], draw.choice(["Yes.", "No.", prose(t, 5), "", "Grüße, 世界!\n x."])) for t in range(700)]  # one long conversation
    rows += [(101, 5, "user", "same.")] * 40 + [(101, None, "assistant", "a."), (101, None, "system", "b.")]  # ties, null turns
    rows += [(None, 1, "user", "x."), (None, 2, None, None), (None, None, "", "no role."), (102, 3, "tool", "x" * 100_000 + "."), (102, 9, "Unknown", "?")]
    rows += [(conv, 0, "user", "gone.") for conv in range(200, 260)]  # some lose their only row
    return rows


@pytest.mark.parametrize("chunk", [5, 4096])
def test_repair_against_plain_loops(spark, monkeypatch, chunk):
    monkeypatch.setattr(role_repair, "CHUNK", chunk)
    rows = talk(3)
    names = [c for c in CLASHES if c not in ("text", "label")] + ["pos", "kind", "audit", "digest", "what", "tie", "numbers"]
    schema = "conv_id long, turn long, role string, text string, " + ", ".join(f"{c} string" for c in names)
    df = spark.createDataFrame([(*r, *["clash"] * len(names)) for r in rows], schema).repartition(5)
    broken = role_repair.damaged(df)
    after = hurt(rows)
    assert Counter(tuple(r) for r in broken.collect()) == Counter(after)
    want, turns = repair_slowly({r[0] for r in rows}, after)
    got = {r[0]: tuple(r[1:]) for r in role_repair.summaries(df, broken).collect()}
    assert got == want
    assert any(v[6] == "" and v[1] == 0 for v in want.values())
    done = defaultdict(list)
    for r in sorted(role_repair.repaired(broken).collect(), key=lambda r: (r.conv_id or -1, r.place)):
        assert r.place == len(done[r.conv_id])
        done[r.conv_id].append((r.role, r.text, r.edit))
    assert done == {c: t for c, t in turns.items() if t}
    if chunk == 5:
        assert role_repair.summaries(df.limit(0), broken.limit(0)).count() == 0


# --- lexicon ------------------------------------------------------------------------------------------------------


def test_transducer_is_minimal_and_exact():
    draw = random.Random(4)
    words = sorted({"".join(draw.choice("abc") for _ in range(draw.randint(1, 6))).encode() for _ in range(300)} | {b"", bytes([0, 255])})
    ids = {w: tuple(draw.randrange(5) for _ in range(draw.randint(0, 3))) for w in words}
    data = lexicon.compiled((w, ids[w]) for w in words)
    own = lexicon.Lexicon(data)
    probes = words + [w + b"d" for w in words] + [w[:-1] for w in words]
    held, border, out = own.look_up(pa.array(probes, pa.large_binary()))
    for k, w in enumerate(probes):
        assert held[k] == (w in ids)
        assert tuple(out[border[k] : border[k + 1]]) == ids.get(w, ())
    # states with the same words and ids ahead are one: as many states as there are different futures
    shared = [w + tail for w in (b"ab", b"cab", b"q") for tail in (b"", b"ing", b"ed")]
    table = lexicon.compiled((w, (len(w),)) for w in sorted(shared))
    assert table[2] < len({w[:i] for w in shared for i in range(len(w) + 1)})
    tails = lexicon.compiled((w, ()) for w in sorted(shared))
    futures = {frozenset(w[len(p) :] for w in shared if w.startswith(p)) for w in shared for p in (w[:i] for i in range(len(w) + 1))}
    assert tails[2] == len(futures)
    empty = lexicon.Lexicon(lexicon.compiled([]))
    assert not empty.look_up(pa.array([b"a"], pa.large_binary()))[0].any()


@pytest.fixture(scope="module")
def library():
    pytest.importorskip("tokenizers")
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    whole.no_truncation()
    whole.no_padding()
    return whole


def odd_strings():
    draw = random.Random(5)
    out = ["", " ", "<|endoftext|> x", "a<|startoftext|>B<|endoftext|>é<|endoftext|>", "<|ENDOFTEXT|>", "<|endoftext|", "it's we'll DON'T 'S", "\x1c\x1d x\x7f\x00"]
    out += ["é ́x   a b  ", "ǅ İstanbul ΑΣ", "12 34,ok!!\n1٣½", "\u0085a\u0085b", "ﬁ Å Å", "a\x0bb\x0cc\rd", "x" * 30_000, "世界" * 3000]
    out += [f"a{chr(i)}b{chr(i)}{chr(i)}1" for i in range(0x300)] + [chr(i) for i in range(0x300)]
    ranges = [(0, 128), (0, 0x250), (0, 0x500), (0x2000, 0x3100), (0x10000, 0x1F9FF), (0, 0xD800)]
    return out + ["".join(chr(draw.randrange(*draw.choice(ranges))) for _ in range(draw.randint(1, 30))) for _ in range(1500)]


def test_ids_and_texts_as_the_library_gives_them(library):
    texts = odd_strings()
    own = lexicon.rules()
    words, *_ = lexicon._words_of(lexicon._pieces(pa.array(texts))[0], own)
    for held in ([], words.to_pylist()[::3]):
        lex = lexicon.Lexicon(lexicon.compiled(sorted((w.encode(), tuple(own.merged(w))) for w in held)))
        ids, decoded = lexicon.encode(pa.array(texts), lex, own)
        for text, a, b in zip(texts, ids, decoded, strict=True):
            want = library.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(a, "<u4").tolist() == want, repr(text)
            assert b.decode() == library.decode(want, skip_special_tokens=False), repr(text)


def test_lexicon_of_documents(spark, odd_docs, odd_texts, no_docs, library):
    want = Counter()
    for i, text, *_ in odd_texts:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        digest = [hashlib.sha256(x).hexdigest() for x in (np.array(ids, "<u4").tobytes(), decoded.encode())]
        want[i, len(ids), *digest, tuple(ids), decoded] += 1
    rows = lexicon.encoded(odd_docs, words=50, keep=("ids", "decoded")).collect()
    assert Counter((*r[:4], tuple(r.ids), r.decoded) for r in rows) == want
    counts = {r.word: r.n for r in lexicon.word_counts(odd_docs).collect()}
    own, seen = lexicon.rules(), Counter()
    for _, text, *_ in odd_texts:
        seen.update(w for piece in re.split("[ \t\n\x0b\x0c\r]+", text or "") for w in own.words(piece))
    assert counts == seen
    assert lexicon.encoded(no_docs).count() == 0
    assert lexicon.encoded(no_docs).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
