"""Secret scans: fixed patterns, and a battery of randomness tests under false-discovery control.

Base spans come from three patterns. Beyond them, long tokens of letters and digits are candidates. Each is read as codes
of the smallest encoding alphabet that holds it, and three tests ask whether it looks like uniform noise: chi-squared
against the alphabet, runs above and below its middle, lag-1 serial correlation. Their z-values add up to a statistic T,
small for noise. How often ordinary text of the same length looks that uniform is counted over the whole corpus: the
letters of every text are cut into windows of all length classes and tested the same way. That gives each candidate a
p-value for its length and alphabet, and the Benjamini-Hochberg rule over all candidates bounds the share of false finds.
p-values are counted in bins of T, so the driver sees one small histogram (STRATA * BINS cells), however many
documents there are.

Defined cases: a null text is an empty one without spans; repeated rows give equal values; a null doc_id stays null; long
texts are searched whole by patterns that never step back over a run; other columns pass or are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywell.llm.common import flat_bytes, steps, table

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
TOKEN = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
KINDS = ("assign", "access", "hex", "random")
#: Cheap linear tests of which texts can have a span of a kind.
MAY_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
MAY_HEX = r"[0-9a-f]{24}"
MAY_TOKEN = r"[A-Za-z0-9+/_-]{20}"

SHORTEST = 20
LENGTHS = (20, 28, 40, 64, 96)
SIZES = (16, 32, 36, 64)
STRATA = len(LENGTHS) * len(SIZES)
BINS, BIN_WIDTH = 256, 0.25
FALSE_SHARE = 0.01
#: T of noise exceeds this once in a thousand tokens (chi-squared with three degrees of freedom).
NOISE_LIMIT = 16.27

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABETS = [
    _DIGITS + "abcdef",
    _DIGITS + "ABCDEF",
    _UPPER + "234567",
    _DIGITS + _LOWER,
    _DIGITS + _UPPER,
    _UPPER + _LOWER + _DIGITS + "+/",
    _UPPER + _LOWER + _DIGITS + "-_",
]


def _code_table(alphabet: str) -> np.ndarray:
    out = np.full(128, -1, np.int64)
    out[[ord(c) for c in alphabet]] = np.arange(len(alphabet))
    return out


_CODES = [_code_table(a) for a in ALPHABETS]
#: Codes of ordinary letters in an alphabet of each size.
_TEXT_CODES = [np.arange(26) % 16, np.arange(26) % 32, np.arange(26) + 10, np.arange(26) + 26]
_CYCLE = sum(LENGTHS)
_CYCLE_WINDOW = np.repeat(np.arange(len(LENGTHS)), LENGTHS)


def battery(codes: np.ndarray, owner: np.ndarray, n: int, size: np.ndarray) -> np.ndarray:
    """T of n tokens; codes of a token stand together, size is its alphabet's."""
    width = int(max(SIZES))
    count = np.bincount(owner, minlength=n).astype(float)
    cells = np.bincount(owner * width + codes, minlength=n * width).reshape(n, width).astype(float)
    some, k = np.maximum(count, 2), size.astype(float)
    chi = (cells**2).sum(axis=1) * k / some - count
    z_chi = (chi - (k - 1)) / np.sqrt(2 * (k - 1) * (some - 1) / some)
    same = owner[1:] == owner[:-1]
    high = codes >= (size[owner] // 2)
    ones = np.bincount(owner, high, n)
    runs = 1 + np.bincount(owner[1:][same], (high[1:] != high[:-1])[same], n)
    pairs = 2 * ones * (count - ones)
    spread = pairs * (pairs - some) / (some**2 * (some - 1))
    z_runs = (runs - (pairs / some + 1)) / np.sqrt(np.maximum(spread, 0.25))
    mean = np.bincount(owner, codes, n) / some
    off = codes - mean[owner]
    power = np.bincount(owner, off**2, n)
    serial = np.bincount(owner[1:][same], (off[1:] * off[:-1])[same], n) / np.maximum(power, 1e-9)
    z_serial = serial * np.sqrt(some) + 1 / np.sqrt(some)
    return np.maximum(z_chi, 0) ** 2 + z_runs**2 + z_serial**2


def to_bin(t: np.ndarray) -> np.ndarray:
    return np.minimum(t / BIN_WIDTH, BINS - 1).astype(np.int64)


def length_class(n: np.ndarray) -> np.ndarray:
    return np.clip(np.searchsorted(LENGTHS, n, side="right") - 1, 0, len(LENGTHS) - 1)


def controls(column: pa.Array) -> np.ndarray:
    """Counts of T over windows of ordinary letters, by stratum and bin; windows lie within one text."""
    data, border = flat_bytes(column)
    folded = data | 0x20
    letter = np.flatnonzero((folded >= 97) & (folded <= 122))
    out = np.zeros(STRATA * BINS, np.int64)
    if not len(letter):
        return out
    row = np.searchsorted(border, letter, side="right") - 1
    place = np.arange(len(letter)) - np.searchsorted(row, np.arange(len(column)))[row]
    cycle, rest = np.divmod(place, _CYCLE)
    number = cycle * len(LENGTHS) + _CYCLE_WINDOW[rest]
    new = np.ones(len(letter), bool)
    new[1:] = (number[1:] != number[:-1]) | (row[1:] != row[:-1])
    owner = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    length, wanted = np.diff(np.append(at, len(letter))), np.array(LENGTHS)[number[at] % len(LENGTHS)]
    kind = (number[at] % len(LENGTHS) + cycle[at]) % len(SIZES)
    codes = np.array(_TEXT_CODES)[kind[owner], folded[letter] - 97]
    t = battery(codes, owner, len(at), np.array(SIZES)[kind])
    whole = length == wanted
    stratum = (number[at] % len(LENGTHS)) * len(SIZES) + kind
    return out + np.bincount((stratum * BINS + to_bin(t))[whole], minlength=STRATA * BINS)


def base_spans(text: str, may: tuple[bool, bool, bool] = (True, True, True)) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns."""
    out = []
    if may[0]:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if may[1]:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if may[2]:
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, end, stratum, bin) of tokens outside base spans that mix letters and digits."""
    found = []
    for m in TOKEN.finditer(text):
        word = m[0].rstrip("=")
        if len(word) < SHORTEST or word.isalpha() or not re.search("[A-Za-z]", word) or not re.search("[0-9]", word):
            continue
        if any(s < m.end() and m.start() < e for s, _, e in base):
            continue
        raw = np.frombuffer(word.encode(), np.uint8)
        codes, alphabet = next(((c, i) for i, a in enumerate(_CODES) if (c := a[raw]).min() >= 0), (None, None))
        if codes is None:  # both kinds of base64 in one token: no encoding
            continue
        size = min(x for x in SIZES if x >= len(ALPHABETS[alphabet]))
        t = battery(codes, np.zeros(len(codes), np.int64), 1, np.array([size]))
        stratum = int(length_class(np.array([len(word)]))[0]) * len(SIZES) + SIZES.index(size)
        found.append((m.start(), m.end(), stratum, int(to_bin(t)[0])))
    return found


def spans_of(column: pa.Array) -> Iterator[tuple[list, list]]:
    """Base spans and candidates of each text."""
    column = pc.fill_null(column, "")
    may = [pc.match_substring_regex(column, MAY_ASSIGN), pc.match_substring(column, "AKIA"), pc.match_substring_regex(column, MAY_HEX), pc.match_substring_regex(column, MAY_TOKEN)]
    masks = np.array([m.to_numpy(zero_copy_only=False) for m in may]).T
    for i, mask in enumerate(masks):
        if not mask.any():
            yield [], []
            continue
        text = column[i].as_py()
        base = base_spans(text, tuple(mask[:3]))
        yield base, candidates(text, base) if mask[3] else []


def survey(docs: DataFrame) -> DataFrame:
    """Spans and candidates of every document, and one row per task with its counts of control windows."""
    span, candidate = "struct<start:int,kind:int,end:int>", "struct<start:int,end:int,stratum:int,bin:int>"
    schema = f"doc_id long, base array<{span}>, candidates array<{candidate}>, controls array<long>"
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    candidate_type = pa.list_(pa.struct([(x, pa.int32()) for x in ("start", "end", "stratum", "bin")]))
    names = ["doc_id", "base", "candidates", "controls"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(STRATA * BINS, np.int64)
        for batch in batches:
            for part in steps(batch, "text", 1 << 20):
                seen += controls(part.column(1))
                found = list(spans_of(part.column(1)))
                base = [[dict(zip(("start", "kind", "end"), s, strict=True)) for s in b] for b, _ in found]
                more = [[dict(zip(("start", "end", "stratum", "bin"), s, strict=True)) for s in c] for _, c in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(base, span_type), pa.array(more, candidate_type), pa.nulls(len(base), pa.list_(pa.int64()))], names=names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, span_type), pa.nulls(1, candidate_type), pa.array([seen.tolist()], pa.list_(pa.int64()))], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def limits(surveyed: DataFrame, false_share: float = FALSE_SHARE) -> list[int]:
    """The highest bin of T per stratum that counts as a secret, -1 for none."""
    cells = surveyed.filter("controls is not null").select(F.posexplode("controls").alias("cell", "n")).groupBy("cell").agg(F.sum("n").alias("n"))
    control = np.zeros(STRATA * BINS)
    for r in cells.filter("n > 0").collect():  # STRATA * BINS rows at most
        control[r["cell"]] = r["n"]
    own = surveyed.select(F.explode("candidates").alias("c")).groupBy((F.col("c.stratum") * BINS + F.col("c.bin")).alias("cell")).agg(F.count("*").alias("n"))
    tested = np.zeros(STRATA * BINS)
    for r in own.collect():
        tested[r["cell"]] = r["n"]
    control = control.reshape(STRATA, BINS)
    p = (1 + control.cumsum(axis=1)) / (1 + control.sum(axis=1, keepdims=True))
    flat, n = p.ravel(), tested
    order = np.argsort(flat, kind="stable")
    passed = np.cumsum(n[order])
    good = (n[order] > 0) & (flat[order] * n.sum() <= false_share * passed)
    cut = flat[order][good].max() if good.any() else -1.0
    noise = int(NOISE_LIMIT / BIN_WIDTH)
    return [int(np.flatnonzero(row <= cut).max(initial=-1)) if (row <= cut).any() else -1 for row in p[:, :noise]]


def _line(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scanned(docs: DataFrame, false_share: float = FALSE_SHARE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    found = table(survey(docs), "secret-survey")
    most = limits(found, false_share)
    bound = F.array(*(F.lit(x) for x in most))
    added = F.filter("candidates", lambda c: c["bin"] <= F.element_at(bound, c["stratum"] + 1))
    added = F.transform(added, lambda c: F.struct(c["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), c["end"].alias("end")))
    names = F.array(*(F.lit(k) for k in KINDS))

    def line(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")

    def number(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return found.filter("controls is null").select(
        "doc_id", *(number(k) for k in KINDS[:3]), F.sha2(line(F.col("base")), 256).alias("base_sha256"), line(F.array_sort(F.concat("base", added))).alias("spans")
    )


def without_secrets(docs: DataFrame, false_share: float = FALSE_SHARE, mark: str = "[secret]") -> DataFrame:
    """All documents, their secrets replaced by a mark; n_chars, where there is one, follows the text."""
    most = limits(table(survey(docs), "secret-survey"), false_share)

    def clean(text: str, base: list, more: list) -> str:
        spans = sorted([(s, e) for s, _, e in base] + [(s, e) for s, e, stratum, b in more if b <= most[stratum]])
        out, at = [], 0
        for s, e in spans:
            if s >= at:
                out += [text[at:s], mark]
            at = max(at, e)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                at = part.schema.get_field_index("text")
                texts = part.column(at).cast(pa.string())
                new = {i: clean(texts[i].as_py(), *found) for i, found in enumerate(spans_of(texts)) if found[0] or found[1]}
                if new:
                    part = part.set_column(at, part.schema.field(at), pa.array([new.get(i, None) if i in new else x for i, x in enumerate(texts.to_pylist())], pa.string()).cast(part.schema.field(at).type))
                    if (n := part.schema.get_field_index("n_chars")) >= 0:
                        sizes = [len(new[i]) if i in new else x for i, x in enumerate(part.column(n).to_pylist())]
                        part = part.set_column(n, part.schema.field(n), pa.array(sizes, part.schema.field(n).type))
                yield part

    return docs.mapInArrow(run, docs.schema)
