"""Personal data: fixed patterns, and a character BiLSTM with CRF transitions, trained in numpy.

Base spans come from four patterns with checks. A bidirectional LSTM over characters and a CRF over B/I tags are trained
from labelled spans: the base spans in a bounded sample of the corpus, and drawn examples in other writings (numbers
without a country code, cards in groups), set into windows of the sample's ordinary text. The model reads every stretch
around a digit or an at sign, since no kind of span does without one; stretches are cut into overlapping windows, all are
decoded by Viterbi, and each character takes its tag from the window in which it stands most central. A span of the model
is added where it passes its kind's check and overlaps no base span.

Defined cases: a null text is an empty one without spans; repeated rows give equal values; a null doc_id stays null;
patterns run in linear time over long texts; without text to sample from, the drawn examples alone train the model.
Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywell.llm.common import steps

KINDS = ("email", "ip", "card", "phone")
WINDOW, REACH = 64, 32
TAGS = 1 + 2 * len(KINDS)
#: Documents of the sample, about, and windows the model is trained on, at most.
SAMPLE_DOCUMENTS, TRAIN_WINDOWS, DRAWN_WINDOWS = 20_000, 800, 400

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a failed address inside a run of digits fails from every later digit too, so tries start at the run and never step back
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ANCHOR = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def valid(kind: int, s: str) -> bool:
    """The check that a span of a kind must pass, whoever found it."""
    if kind == 0:
        left, _, right = s.partition("@")
        return bool(LOCAL.fullmatch(left) and DOMAIN.fullmatch(right))
    if kind == 1:
        parts = s.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and _small(p) for p in parts)
    d = _digits(s)
    if kind == 2:
        return 13 <= len(d) <= 19 and bool(re.fullmatch(r"[0-9](?:[\x20.-]?[0-9])+", s)) and luhn(d)
    return 10 <= len(d) <= 15 and bool(re.fullmatch(r"[+(]?[0-9][\x20().0-9-]*[0-9]", s))


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches without overlap: each at sign with what may stand before and after it."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns."""
    out = [(s, 0, e) for s, e in emails(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(_small, m[0].split(".")))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out)


# -- the model ---------------------------------------------------------------------------
SYMBOLS = 100


def codes(text: str) -> np.ndarray:
    """A number below SYMBOLS for each character; 0 is what stands outside of a text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.where((points >= 32) & (points < 127), points - 30, np.where(points < 32, 1, 97 + (points > 0x24F)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _lstm(x: np.ndarray, table: np.ndarray, back: np.ndarray, keep: bool = False):
    """Hidden states (steps, rows, units) of an LSTM over codes (rows, steps); table holds each code's gate inputs."""
    rows, length = x.shape
    units = back.shape[0]
    h, c = np.zeros((rows, units), np.float32), np.zeros((rows, units), np.float32)
    out, trace = np.empty((length, rows, units), np.float32), []
    for t in range(length):
        z = table[x[:, t]] + h @ back
        gates = _sigmoid(z[:, : 3 * units])
        g = np.tanh(z[:, 3 * units :])
        i, f, o = gates[:, :units], gates[:, units : 2 * units], gates[:, 2 * units :]
        old_c, old_h, c = c, h, f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        out[t] = h
        if keep:
            trace.append((i, f, o, g, old_c, old_h, tc))
    return out, trace


def _lstm_back(x, back, trace, grad):
    """Gradients of the code table and of the recurrent matrix."""
    units = back.shape[0]
    d_inputs, d_back = np.empty((len(trace), len(x), 4 * units), np.float32), np.zeros_like(back)
    dh, dc = np.zeros_like(grad[0]), np.zeros_like(grad[0])
    for t in range(len(trace) - 1, -1, -1):
        i, f, o, g, old_c, old_h, tc = trace[t]
        dh = dh + grad[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.hstack([dc * g * i * (1 - i), dc * old_c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)])
        d_inputs[t] = dz
        d_back += old_h.T @ dz
        dh, dc = dz @ back.T, dc * f
    which = (x.T.reshape(-1, 1) == np.arange(SYMBOLS)).astype(np.float32)
    return which.T @ d_inputs.reshape(len(which), -1), d_back


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


@dataclass
class Tagger:
    """Weights: code tables and recurrent matrices of both directions, output layer, transitions."""

    weights: dict[str, np.ndarray]

    @classmethod
    def start(cls, units: int, seed: int) -> Tagger:
        draw = np.random.default_rng(seed)
        shapes = {"table_f": (SYMBOLS, 4 * units), "back_f": (units, 4 * units), "table_b": (SYMBOLS, 4 * units), "back_b": (units, 4 * units), "out": (2 * units, TAGS), "bias": (TAGS,), "move": (TAGS, TAGS)}
        weights = {k: (draw.standard_normal(s) * (0.1 if k in ("bias", "move") else 0.3)).astype(np.float32) for k, s in shapes.items()}
        for k in ("table_f", "table_b"):
            weights[k][:, units : 2 * units] += 0.5  # remember at first
        return cls(weights)

    def scores(self, x: np.ndarray, keep: bool = False):
        w = self.weights
        ahead, trace_f = _lstm(x, w["table_f"], w["back_f"], keep)
        behind, trace_b = _lstm(x[:, ::-1], w["table_b"], w["back_b"], keep)
        hidden = np.concatenate([ahead, behind[::-1]], axis=2)
        return hidden @ w["out"] + w["bias"], hidden, trace_f, trace_b

    def loss_gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        w, (rows, length) = self.weights, x.shape
        score, hidden, trace_f, trace_b = self.scores(x, keep=True)
        move, each = w["move"], np.arange(rows)
        alpha, beta = np.empty_like(score), np.zeros_like(score)
        alpha[0] = score[0]
        for t in range(1, length):
            alpha[t] = score[t] + _log_sum(alpha[t - 1][:, :, None] + move, 1)
        for t in range(length - 2, -1, -1):
            beta[t] = _log_sum(move + (score[t + 1] + beta[t + 1])[:, None, :], 2)
        z = _log_sum(alpha[-1], 1)
        d_score = np.exp(alpha + beta - z[None, :, None])
        d_move = np.zeros_like(move)
        gold = score[0][each, y[:, 0]].astype(np.float64)
        d_score[0][each, y[:, 0]] -= 1
        for t in range(1, length):
            d_move += np.exp(alpha[t - 1][:, :, None] + move + (score[t] + beta[t])[:, None, :] - z[:, None, None]).sum(axis=0)
            np.add.at(d_move, (y[:, t - 1], y[:, t]), -1)
            gold += score[t][each, y[:, t]] + move[y[:, t - 1], y[:, t]]
            d_score[t][each, y[:, t]] -= 1
        d_hidden = d_score @ w["out"].T
        units = w["back_f"].shape[0]
        table_f, back_f = _lstm_back(x, w["back_f"], trace_f, d_hidden[:, :, :units])
        table_b, back_b = _lstm_back(x[:, ::-1], w["back_b"], trace_b, d_hidden[::-1, :, units:])
        flat = d_score.reshape(-1, TAGS)
        grads = {"table_f": table_f, "back_f": back_f, "table_b": table_b, "back_b": back_b, "out": hidden.reshape(len(flat), -1).T @ flat, "bias": flat.sum(axis=0), "move": d_move}
        return float((z - gold).mean()), {k: v / rows for k, v in grads.items()}

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tag sequence of each window (Viterbi)."""
        score, move = self.scores(x)[0], self.weights["move"]
        best, came = score[0], []
        for t in range(1, len(score)):
            way = best[:, :, None] + move
            came.append(way.argmax(axis=1))
            best = score[t] + way.max(axis=1)
        out = np.empty(x.shape, np.int64)
        out[:, -1] = best.argmax(axis=1)
        for t in range(len(came) - 1, -1, -1):
            out[:, t] = came[t][np.arange(len(x)), out[:, t + 1]]
        return out


def train(x: np.ndarray, y: np.ndarray, units: int = 24, epochs: int = 16, rows: int = 64, rate: float = 0.01, seed: int = 5) -> Tagger:
    """Adam over shuffled batches; the same windows give the same model."""
    model, draw = Tagger.start(units, seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in model.weights.items()}
    second = {k: np.zeros_like(v) for k, v in model.weights.items()}
    step, steps_all = 0, max(1, epochs * -(-len(x) // rows))
    for _ in range(epochs):
        order = draw.permutation(len(x))
        for begin in range(0, len(x), rows):
            own = order[begin : begin + rows]
            _, grads = model.loss_gradients(x[own], y[own])
            step += 1
            now = rate * (1 - 0.9 * step / steps_all)
            for k, g in grads.items():
                g = np.clip(g, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                model.weights[k] = (model.weights[k] - now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model


# -- labelled windows --------------------------------------------------------------------
def tags_of(size: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    out = np.zeros(size, np.int64)
    for s, kind, e in spans:
        out[max(s, 0) : e] = 2 + 2 * kind
        if s >= 0:
            out[s] = 1 + 2 * kind
    return out


def drawn(plain: list[str], n: int, seed: int = 9) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Windows of ordinary text with one drawn span each, or with a number that is none."""
    draw = random.Random(seed)
    plain = [p for p in plain if len(p) >= WINDOW] or ["".join(draw.choice("etaoin shrdlu ") for _ in range(WINDOW)) for _ in range(50)]

    def number(k: int) -> str:
        return "".join(draw.choice("0123456789") for _ in range(k))

    def card() -> str:
        body = draw.choice("3456") + number(draw.choice((13, 14, 14, 14, 15)))
        return next(body + c for c in "0123456789" if luhn(body + c))

    def word() -> str:
        return "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(2, 8)))

    def make(kind: int) -> str:
        if kind == 0:
            return f"{word()}{draw.choice(['', '.', '_'])}{draw.choice([word(), number(2)])}@{word()}{draw.choice(['', number(1), '-' + word()])}.{draw.choice(['example.com', 'org', 'net', 'co.uk'])}"
        if kind == 1:
            return ".".join(str(draw.randint(0, 255)) for _ in range(4))
        if kind == 2:
            c = card()
            return draw.choice([c, c, " ".join(c[i : i + 4] for i in range(0, len(c), 4)), "-".join(c[i : i + 4] for i in range(0, len(c), 4))])
        return draw.choice(["", "", "+1 ", "+44 ", "+49 "]) + draw.choice([f"({number(3)}) {number(3)}-{number(4)}", f"{number(3)}-{number(3)}-{number(4)}", f"{number(3)} {number(3)} {number(4)}"])

    out = []
    for i in range(n):
        text, kind = draw.choice(plain)[:WINDOW], i % (len(KINDS) + 1)
        own = make(kind) if kind < len(KINDS) else draw.choice([number(draw.randint(1, 6)), f"{number(1)}.{number(1)}", f"{draw.randint(1900, 2030)}-{draw.randint(10, 12)}-{draw.randint(10, 28)}"])
        at = draw.choice([0, *(m.end() for m in re.finditer(r"\s", text[: WINDOW - len(own)]))])
        text = f"{text[:at]}{own} {text[at:]}"[:WINDOW]
        out.append((text, [(at, kind, at + len(own))] if kind < len(KINDS) else []))
    return out


def sample_windows(docs: DataFrame) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Windows around labelled spans and of ordinary text, from documents chosen by a hash of their id."""
    share = min(1.0, SAMPLE_DOCUMENTS / max(1, docs.count()))
    chosen = docs.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1_000_000)) < int(share * 1_000_000) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                texts, starts, labels = [], [], []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    text, salt = text or "", (doc or 0) % 37
                    base = base_spans(text)
                    places = [max(0, s - 10 - salt) for s, _, _ in base] or ([(doc or 0) * 7919 % (len(text) - WINDOW)] if len(text) > WINDOW else [])
                    for at in places:
                        own = [x for s, k, e in base if s < at + WINDOW and e > at for x in (s - at, k, min(e - at, WINDOW))]
                        if not own and ANCHOR.search(text, at, at + WINDOW):
                            continue  # it may hold personal data that no base pattern labels
                        texts.append(text[at : at + WINDOW]), starts.append(doc), labels.append(own)
                yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int64()), pa.array(texts, pa.string()), pa.array(labels, pa.list_(pa.int32()))], names=["doc_id", "window", "labels"])

    windows = chosen.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, window string, labels array<int>")
    order = [F.xxhash64("window"), F.col("window")]
    with_spans, plain = F.size("labels") > 0, F.size("labels") == 0
    rows = windows.filter(with_spans).orderBy(*order).limit(TRAIN_WINDOWS).collect() + windows.filter(plain).orderBy(*order).limit(TRAIN_WINDOWS // 2).collect()
    return [(r["window"], [tuple(r["labels"][i : i + 3]) for i in range(0, len(r["labels"]), 3)]) for r in rows]


def fitted(docs: DataFrame, units: int = 24, epochs: int = 16) -> Tagger:
    """A tagger from the corpus's labelled windows and drawn ones; no more than a bounded number of windows."""
    own = sample_windows(docs)
    windows = own + drawn([w for w, s in own if not s], DRAWN_WINDOWS)
    x, y = np.zeros((len(windows), WINDOW), np.int64), np.zeros((len(windows), WINDOW), np.int64)
    for i, (text, spans) in enumerate(windows):
        x[i, : len(text)], y[i, : len(text)] = codes(text), tags_of(len(text), spans)
    return train(x, y, units, epochs)


# -- finding -----------------------------------------------------------------------------
def stretches(text: str) -> list[tuple[int, int]]:
    """Where a span can lie: REACH characters around digits and at signs, merged."""
    out: list[list[int]] = []
    for m in ANCHOR.finditer(text):
        if out and m.start() - REACH <= out[-1][1]:
            out[-1][1] = m.start() + REACH
        else:
            out.append([m.start() - REACH, m.start() + REACH])
    return [(max(0, a), min(len(text), b)) for a, b in out]


def windows_of(a: int, b: int) -> list[int]:
    """First characters of windows that cover a stretch and overlap by half."""
    return list(range(a, max(a + 1, b - WINDOW // 2), WINDOW // 2))


def model_spans(texts: list[str], model: Tagger, rows: int = 512) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) that the model finds in each text, each character tagged by its most central window."""
    jobs = [(i, a, b, w) for i, text in enumerate(texts) for a, b in stretches(text) for w in windows_of(a, b)]
    tags: dict[tuple[int, int, int], np.ndarray] = {}
    centre: dict[tuple[int, int, int], np.ndarray] = {}
    for begin in range(0, len(jobs), rows):
        part = jobs[begin : begin + rows]
        x = np.zeros((len(part), WINDOW), np.int64)
        for r, (i, _, b, w) in enumerate(part):
            piece = codes(texts[i][w : min(b, w + WINDOW)])
            x[r, : len(piece)] = piece
        for (i, a, b, w), own in zip(part, model.decode(x), strict=True):
            key = (i, a, b)
            if key not in tags:
                tags[key], centre[key] = np.zeros(b - a, np.int64), np.full(b - a, -1)
            size = min(b, w + WINDOW) - w
            inner = np.minimum(np.arange(size), WINDOW - 1 - np.arange(size))
            better = inner > centre[key][w - a : w - a + size]
            tags[key][w - a : w - a + size][better] = own[:size][better]
            centre[key][w - a : w - a + size][better] = inner[better]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (i, a, _), own in tags.items():
        at = 0
        while at < len(own):
            if not own[at]:
                at += 1
                continue
            kind, end = (own[at] - 1) // 2, at + 1
            while end < len(own) and own[end] == 2 + 2 * kind:
                end += 1
            raw = texts[i][a + at : a + end]
            start = a + at + len(raw) - len(raw.lstrip(" .,;:!"))
            stop = a + at + len(raw.rstrip(" .,;:!"))
            beside = texts[i][max(0, start - 1) : start] + texts[i][stop : stop + 1]
            if start < stop and not re.search("[0-9A-Za-z]", beside) and valid(int(kind), texts[i][start:stop]):
                out[i].append((start, int(kind), stop))
            at = end
    return out


def _line(spans: list[tuple[int, int, int]], names: tuple[str, ...]) -> str:
    return ",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans)


def scanned(docs: DataFrame, model: Tagger) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every document; the model's kinds are named lstm_*."""
    names = (*KINDS, *(f"lstm_{k}" for k in KINDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text", 1 << 20):
                column = pc.fill_null(part.column(1), "")
                some = np.flatnonzero(pc.match_substring_regex(column, "[0-9@]").to_numpy(zero_copy_only=False))
                texts = column.take(pa.array(some)).to_pylist()
                base = [base_spans(t) for t in texts]
                more = [[s for s in own if all(s[2] <= b[0] or b[2] <= s[0] for b in fixed)] for own, fixed in zip(model_spans(texts, model), base, strict=True)]
                counts = np.zeros((len(column), len(KINDS)), np.int64)
                hashes, lines = [hashlib.sha256(b"").hexdigest()] * len(column), [""] * len(column)
                for i, fixed, added in zip(some, base, more, strict=True):
                    for _, k, _ in fixed:
                        counts[i, k] += 1
                    hashes[i] = hashlib.sha256(_line(fixed, names).encode()).hexdigest()
                    lines[i] = _line(sorted(fixed + [(s, k + len(KINDS), e) for s, k, e in added]), names)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c) for c in counts.T), pa.array(hashes, pa.string()), pa.array(lines, pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
