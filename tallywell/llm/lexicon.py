"""BPE ids by a lexicon of frequent words in a minimal acyclic transducer; all other words are merged.

The words of all documents are counted; the most frequent ones (a bound on the lexicon, not on the text) are merged once and
compiled, in sorted order, into an automaton whose equal suffix states are shared. Ids stand on the arcs as early as they are
certain and the rest of an output moves down its path. The automaton is one file of whole numbers in the shared folder;
Spark hands it to the executors, and their workers map it into memory, so the workers of one machine share its pages.

A text is cut at ASCII white space, where no rule of the tokenizer reaches across. Each different piece of a step is
normalised and split into words once (Latin letters by one pattern, the rest by the tokenizer's own rules), all words of a
step walk the automaton together, byte by byte, and a word that it does not hold is merged exactly, pair by pair in the order of the ranks.

Defined cases: a null text is an empty one: no ids, an empty text back. Very long words are merged in n log n. Repeated rows
are encoded one by one; an empty table gives no rows. Special tokens in a text are the tokenizer's special ids. Other columns are
not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywell.llm.common import steps
from tallywell.session import shared_dir

#: Words of the lexicon.
LEXICON_WORDS = 131_072
#: Bytes of text that are encoded together.
STEP = 4 << 20
#: Different words that a counting task holds before it hands its counts on.
HELD_WORDS = 200_000
#: Words that were merged and that a Python worker keeps.
KEPT_WORDS = 300_000
#: Longer words are merged with a heap.
SHORT = 64
#: Below this character NFC changes nothing, and letters, numbers and white space are those of any Unicode version.
PLAIN_END = 0x250
#: Text that goes the tokenizer's own way: other characters, the one capital letter that becomes two characters, special tokens.
_NOT_PLAIN = r"[^\x00-\x{24f}]|\x{130}|<\|"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> str:
    """The letter of each byte: itself where it prints, else the next letter from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return "".join(chr(b if b in prints else next(other)) for b in range(256))


def _plain_pattern() -> str:
    """Words of lower-case plain text: contractions, letters, single numbers, anything else; a line end is a word of its own."""
    kinds: dict[str, list[str]] = {"L": [], "N": [], "Z": []}
    for c in map(chr, range(PLAIN_END)):
        kind = "Z" if c in "\t\n\x0b\x0c\r\x85" else unicodedata.category(c)[0]
        kinds.get(kind, []).append(re.escape(c))
    letters, numbers, blanks = ("".join(kinds[k]) for k in "LNZ")
    beyond = "".join(sorted({x for c in map(chr, range(PLAIN_END)) for x in c.lower() if ord(x) >= PLAIN_END and c != "\u0130"}))
    return f"\\n|'s|'t|'re|'ve|'m|'ll|'d|[{letters}{beyond}]+|[{numbers}]|[^{letters}{beyond}{numbers}{blanks}]+"


_PLAIN_WORDS = re.compile(_plain_pattern())


class Rules:
    """What a vocabulary file says: words of a piece of text, and the merges of a word."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            stated = json.load(file)
        model = stated["model"]
        self.vocabulary: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"]
        self.rank = {tuple(pair): n for n, pair in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in stated["added_tokens"]}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        whole = Tokenizer.from_file(path)
        self._normalise, self._split = whole.normalizer.normalize_str, whole.pre_tokenizer.pre_tokenize_str
        text = {i: t for t, i in (self.vocabulary | self.special).items()}
        self.tokens = [text[i].encode() + b" " for i in range(max(text) + 1)]  # each with the blank after it
        self._byte = {b: letter for b, letter in enumerate(_byte_letters())}
        self._kept: dict[str, list[int]] = {}

    def words(self, piece: str) -> list[str]:
        """The words of a piece of text, in the letters of the vocabulary; special tokens as they are."""
        out = []
        for k, part in enumerate(self._special.split(piece)):
            out += [part] if k % 2 else [word for word, _ in self._split(self._normalise(part))]
        return out

    def plain_words(self, pieces: list[str]) -> list[str]:
        """The words of plain pieces, with a line end after the words of each."""
        return _PLAIN_WORDS.findall("\n".join([*pieces, ""]).lower())

    def letters(self, word: str) -> str:
        """A word of a plain piece in the letters of the vocabulary."""
        return word.encode().decode("latin-1").translate(self._byte)

    def merged(self, word: str) -> list[int]:
        """The ids of a word: of all neighbours the pair with the least rank, the leftmost first, becomes one, until none has a rank."""
        if word in self.special:
            return [self.special[word]]
        if word in self._kept:
            return self._kept[word]
        ids = self._merge(word)
        if len(word) <= 40:
            if len(self._kept) >= KEPT_WORDS:
                self._kept.clear()
            self._kept[word] = ids
        return ids

    def _merge(self, word: str) -> list[int]:
        symbols = [s for s in (*word[:-1], word[-1] + self.suffix) if s in self.vocabulary]
        return self._merge_long(symbols) if len(symbols) > SHORT else self._merge_short(symbols)

    def _merge_short(self, symbols: list[str]) -> list[int]:
        """A list of the neighbours' ranks, looked through for each merge."""
        rank, never = self.rank, len(self.rank)
        ranks = [rank.get(pair, never) for pair in zip(symbols, symbols[1:], strict=False)]
        while ranks and (least := min(ranks)) < never:
            i = ranks.index(least)
            symbols[i] += symbols.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = rank.get((symbols[i - 1], symbols[i]), never)
            if i < len(ranks):
                ranks[i] = rank.get((symbols[i], symbols[i + 1]), never)
        return [self.vocabulary[s] for s in symbols]

    def _merge_long(self, symbols: list[str | None]) -> list[int]:
        """A heap of the neighbours' ranks over a linked list."""
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        heap: list[tuple[int, int, str, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(symbols):
                pair = (symbols[i], symbols[after[i]])
                if pair in self.rank:
                    heapq.heappush(heap, (self.rank[pair], i, *pair))

        for i in range(len(symbols) - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= len(symbols) or symbols[j] != b:
                continue  # one of the two has become part of another symbol
            symbols[i], symbols[j], after[i] = a + b, None, after[j]
            if after[j] < len(symbols):
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [self.vocabulary[s] for s in symbols if s is not None]


_RULES: dict[str, Rules] = {}


def rules(path: str | None = None) -> Rules:
    path = path or default_vocabulary()
    if path not in _RULES:
        _RULES[path] = Rules(path)
    return _RULES[path]


class _State:
    __slots__ = ("arcs", "final", "rest")

    def __init__(self) -> None:
        self.arcs: dict[int, list] = {}  # byte: [state, ids on the arc]
        self.final, self.rest = False, ()

    def shape(self) -> tuple:
        return self.final, self.rest, tuple((b, id(to), ids) for b, (to, ids) in self.arcs.items())


def compiled(entries: Iterable[tuple[bytes, tuple[int, ...]]]) -> np.ndarray:
    """The minimal acyclic transducer of sorted different words as one array.

    Header: arcs, ids, states. Then by arc, in the order of (state, byte): state * 256 + byte, target, begin and end of
    its ids; by state: begin and end of the ids that end a word there, -1 where none does; the ids. State 0 is the start.
    """
    known: dict[tuple, _State] = {}
    path, last = [_State()], b""

    def settle(depth: int) -> None:
        """Replace states below the depth that have an equal among the settled ones."""
        while len(path) > depth + 1:
            child = path.pop()
            path[-1].arcs[last[len(path) - 1]][0] = known.setdefault(child.shape(), child)

    for word, ids in entries:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        settle(same)
        for byte in word[same:]:
            state = _State()
            path[-1].arcs[byte] = [state, ()]
            path.append(state)
        last = word
        path[-1].final = True
        rest = tuple(ids)
        for depth in range(same):  # ids that the shared path states stay, others move below
            arc = path[depth].arcs[word[depth]]
            common = 0
            while common < min(len(arc[1]), len(rest)) and arc[1][common] == rest[common]:
                common += 1
            moved, arc[1], rest = arc[1][common:], arc[1][:common], rest[common:]
            if moved:
                below = path[depth + 1]
                for under in below.arcs.values():
                    under[1] = moved + under[1]
                if below.final and depth + 1 < len(word):
                    below.rest = moved + below.rest
        if same < len(word):
            path[same].arcs[word[same]][1] = rest
        else:
            path[-1].rest = rest
    settle(0)

    number: dict[int, int] = {id(path[0]): 0}
    states, arcs, pool, place = [path[0]], [], [], {}

    def kept(ids: tuple[int, ...]) -> tuple[int, int]:
        if ids not in place:
            place[ids] = len(pool)
            pool.extend(ids)
        return place[ids], place[ids] + len(ids)

    ends = []
    for state in states:
        for byte, (to, ids) in sorted(state.arcs.items()):
            if id(to) not in number:
                number[id(to)] = len(states)
                states.append(to)
            arcs.append((number[id(state)] * 256 + byte, number[id(to)], *kept(ids)))
        ends.append(kept(state.rest) if state.final else (-1, -1))
    table = np.array(arcs, np.int32).reshape(-1, 4)
    return np.concatenate([np.array([len(arcs), len(pool), len(states)], np.int32), table.T.ravel(), np.array(ends, np.int32).T.ravel(), np.array(pool, np.int32)])


class Lexicon:
    """A compiled transducer; looks up many words at once."""

    def __init__(self, data: np.ndarray):
        arcs, ids, states = (int(x) for x in data[:3])
        at = 3
        self.key, self.to, self.begin, self.end = data[at : at + 4 * arcs].reshape(4, arcs)
        at += 4 * arcs
        self.rest_begin, self.rest_end = data[at : at + 2 * states].reshape(2, states)
        self.ids = data[at + 2 * states : at + 2 * states + ids]

    def look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each word is held, the borders of the words' ids, and the ids."""
        words = words.cast(pa.large_binary())
        n = len(words)
        if not n or not len(self.key):
            return np.zeros(n, bool), np.zeros(n + 1, np.int64), np.empty(0, np.int32)
        _, offsets, data = words.buffers()
        start = np.frombuffer(offsets, np.int64)[words.offset : words.offset + n + 1]
        size = np.diff(start)
        text = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
        state = np.zeros(n, np.int32)
        going = np.arange(n)
        held = np.zeros(n, bool)
        given: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        depth = 0
        while len(going):
            ended = size[going] == depth
            done = going[ended]
            final = self.rest_begin[state[done]] >= 0
            held[done[final]] = True
            given.append((done[final], self.rest_begin[state[done[final]]], self.rest_end[state[done[final]]]))
            going = going[~ended]
            wanted = state[going] * 256 + text[start[going] + depth]
            arc = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
            found = self.key[arc] == wanted
            going, arc = going[found], arc[found]
            state[going] = self.to[arc]
            given.append((going, self.begin[arc], self.end[arc]))
            depth += 1
        count = np.zeros(n, np.int64)
        given = [(w[held[w]], b[held[w]], e[held[w]]) for w, b, e in given]
        for word, begin, end in given:
            count[word] += end - begin
        border = np.concatenate([[0], np.cumsum(count)])
        out, fill = np.empty(border[-1], np.int32), border[:-1].copy()
        for word, begin, end in given:
            length = (end - begin).astype(np.int64)
            some = length > 0
            word, begin, length = word[some], begin[some], length[some]
            inside = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            out[np.repeat(fill[word], length) + inside] = self.ids[np.repeat(begin, length) + inside]
            fill[word] += length
        return held, border, out


def _pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different pieces of the texts between ASCII white space, the piece at every place, and the borders of the rows."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat = lists.flatten()
    border = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    coded = flat.dictionary_encode()
    piece = coded.indices.to_numpy(zero_copy_only=False)
    return coded.dictionary, piece, border


def _words_of(pieces: pa.Array, own: Rules) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of the pieces, the word at every place, and where each piece's words begin and end."""
    plain = ~pc.match_substring_regex(pieces, _NOT_PLAIN).to_numpy(zero_copy_only=False)
    found = pa.array(own.plain_words(pieces.filter(pa.array(plain)).to_pylist()), pa.large_string()).dictionary_encode()
    texts, place = found.dictionary.to_pylist(), found.indices.to_numpy(zero_copy_only=False)
    line_end = texts.index("\n") if texts else -1
    for i in np.flatnonzero(pc.match_substring_regex(found.dictionary, "[^!-~]").to_numpy(zero_copy_only=False)):
        texts[i] = own.letters(texts[i])
    is_word = place != line_end
    ends = np.cumsum(is_word)[~is_word]
    words = [place[is_word].astype(np.int64)]
    begin, end = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
    begin[plain], end[plain] = np.concatenate([[0], ends[:-1]]) if len(ends) else 0, ends
    at = len(words[0])
    number = {} if plain.all() else {w: n for n, w in enumerate(texts)}
    for i in np.flatnonzero(~plain):
        parts = [number.setdefault(w, len(number)) for w in own.words(pieces[i].as_py())]
        begin[i], end[i] = at, at + len(parts)
        at += len(parts)
        words.append(np.array(parts, np.int64))
    texts += list(number)[len(texts) :]
    return pa.array(texts, pa.large_string()), np.concatenate(words), np.stack([begin, end])


def word_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """word, n over the whole texts of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = rules(vocabulary), Counter()

        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for step in steps(batch, "text", STEP):
                pieces, piece, _ = _pieces(step.column(0))
                times = np.bincount(piece, minlength=len(pieces))
                words, word, (begin, end) = _words_of(pieces, own)
                by_place = np.zeros(len(word) + 1, np.int64)
                np.add.at(by_place, begin, times)
                np.subtract.at(by_place, end, times)
                counts = np.bincount(word, np.cumsum(by_place)[:-1], len(words)).astype(np.int64)
                for w, n in zip(words.to_pylist(), counts.tolist(), strict=True):
                    if n:
                        seen[w] += n
                if len(seen) >= HELD_WORDS:
                    yield handed()
                    seen.clear()
        yield handed()

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def compiled_lexicon(docs: DataFrame, words: int = LEXICON_WORDS, vocabulary: str | None = None) -> np.ndarray:
    """The transducer of the most frequent words (ties by the word); their ids are merged in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = rules(vocabulary)
        for batch in batches:
            ids = pa.array([own.merged(w) for w in batch.column(0).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["word", "ids"])

    top = word_counts(docs, vocabulary).orderBy(F.desc("n"), "word").limit(words).select("word")
    rows = top.repartition("word").mapInArrow(run, "word string, ids array<int>").toArrow()  # at most `words` rows
    return compiled(sorted((w.encode(), tuple(ids)) for w, ids in zip(rows["word"].to_pylist(), rows["ids"].to_pylist(), strict=True)))


def shared_file(spark: SparkSession, data: np.ndarray, purpose: str) -> str:
    """Write the numbers as a file in the shared folder and have Spark give it to every executor; the name to ask SparkFiles for."""
    place = shared_dir(spark, purpose) + ".int32"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(place)
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(data.astype("<i4").tobytes()))
    out.close()
    spark.sparkContext.addFile(place)
    return place.rsplit("/", 1)[1]


_LEXICONS: dict[str, Lexicon] = {}


def mapped(name: str) -> Lexicon:
    """The lexicon in a file that Spark has brought here, mapped into memory."""
    if name not in _LEXICONS:
        _LEXICONS[name] = Lexicon(np.memmap(SparkFiles.get(name), "<i4", "r"))
    return _LEXICONS[name]


def encode(texts: pa.Array, lexicon: Lexicon, own: Rules) -> tuple[list[bytes], list[bytes]]:
    """By text, its ids as little-endian unsigned 32-bit numbers, and the decoded text in UTF-8."""
    pieces, piece, rows = _pieces(texts)
    words, word, (begin, end) = _words_of(pieces, own)
    held, border, ids = lexicon.look_up(words)
    number, own_ids = ids.tolist(), ids.astype("<u4").tobytes()
    spans = list(zip(border.tolist(), border[1:].tolist(), strict=False))
    by_word = [own_ids[4 * a : 4 * b] for a, b in spans]
    text_of_word = [b"".join([own.tokens[i] for i in number[a:b]]) for a, b in spans]
    unseen = np.flatnonzero(~held)
    for w, text in zip(unseen.tolist(), words.take(pa.array(unseen)).to_pylist(), strict=True):
        merged = own.merged(text)
        by_word[w] = np.array(merged, "<u4").tobytes()
        text_of_word[w] = b"".join([own.tokens[i] for i in merged])
    places, spans = word.tolist(), list(zip(begin.tolist(), end.tolist(), strict=True))
    by_piece = [b"".join([by_word[w] for w in places[a:b]]) for a, b in spans]
    text_of_piece = [b"".join([text_of_word[w] for w in places[a:b]]) for a, b in spans]
    chosen, at = piece.tolist(), rows.tolist()
    own_rows = [chosen[a:b] for a, b in zip(at, at[1:], strict=False)]
    return [b"".join([by_piece[i] for i in row]) for row in own_rows], [b"".join([text_of_piece[i] for i in row])[:-1] for row in own_rows]


def encoded(docs: DataFrame, words: int = LEXICON_WORDS, vocabulary: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document; `keep` adds ids (array) and decoded (text)."""
    name = shared_file(docs.sparkSession, compiled_lexicon(docs, words, vocabulary), "lexicon")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, lexicon = rules(vocabulary), mapped(name)
        for batch in batches:
            for step in steps(batch, "text", STEP):
                ids, decoded = encode(step.column(1), lexicon, own)
                out = [
                    step.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
                ]
                if "ids" in keep:
                    out.append(pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32())))
                if "decoded" in keep:
                    out.append(pa.array([x.decode() for x in decoded], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=names)

    extra = {"ids": "array<int>", "decoded": "string"}
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *[c for c in extra if c in keep]]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + "".join(f", {c} {extra[c]}" for c in extra if c in keep)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
