"""Repair of conversation structure by generalised LR parsing over the role grammar.

Roles are read by their initials. The grammar (an optional system turn, then pairs of user and assistant, or nothing) is
compiled into LR states; a graph-structured stack reads the rows and every top may delete the row, shift it as it is,
shift it under another role, or shift an inserted turn. Links between the same two nodes are merged by the smallest
(cost, audit). No two different audits of one cost that have read the same rows are prefixes of one another, so merging early is exact.

Rows are dealt out in ranges of (conversation, turn, role, text) and each range is read in chunks of at most `CHUNK` rows. A
chunk that may begin inside a conversation is parsed from each of the grammar's few stacks and gives costs and audits
between stacks; audits end with the row they read, so those of one chunk are never prefixes of one another, and a walk
from the last chunk back picks the least (cost, audit) from ranks alone. So a conversation of any length is parsed in
many tasks. Only its SHA-256, which reads the text in order, streams through one task, holding one row at a time.

Defined cases: a null role or text is one space, in the damage key a null id or turn is one space too; null ids are one
conversation. Null turns stand first. Rows of one turn stand by role, then by the SHA-256 of role and text; equal rows
are interchangeable. An empty role has no initial and can only be changed or deleted. Empty and very long texts are
ordinary values. A conversation without rows has zeros, an empty audit and the hash of nothing; an empty table gives no
rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from functools import cache
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywell.llm.common import table

CHUNK = 4096
#: Results of short chunks that a Python worker keeps.
KEPT_CHUNKS = 50_000

START, END = "S", "$"
GRAMMAR = (("S", ""), ("S", "T"), ("S", "sT"), ("T", "ua"), ("T", "Tua"))
#: Roles that a row may be given, by initial.
GIVEN = "ua"
ADJACENT = ("su", "ua", "au")


class Prices(NamedTuple):
    """What the edits cost; `truncated` is added for a truncated row that stays."""

    delete: int = 4
    rerole: int = 3
    insert: int = 3
    truncated: int = 3


class Automaton:
    """LR(0) states of a grammar whose terminals are lower-case letters.

    `step` has a state's successors by symbol, `always` the production of a state that can do nothing but reduce, and
    `at_end` the productions that states with another choice reduce at the end of the input.
    """

    def __init__(self, grammar: tuple[tuple[str, str], ...]):
        self.step: list[dict[str, int]] = []
        self.always: dict[int, tuple[str, int]] = {}
        self.at_end: dict[int, list[tuple[str, int]]] = {}
        kernels: dict[frozenset, int] = {}

        def state_of(kernel: frozenset) -> int:
            if kernel in kernels:
                return kernels[kernel]
            own = kernels[kernel] = len(self.step)
            self.step.append({})
            items, todo = set(kernel), list(kernel)
            while todo:
                head, body, at = todo.pop()
                for lhs, rhs in grammar:
                    if at < len(body) and body[at] == lhs and (lhs, rhs, 0) not in items:
                        items.add((lhs, rhs, 0))
                        todo.append((lhs, rhs, 0))
            whole = [(head, len(body)) for head, body, at in items if at == len(body)]
            if len(whole) == len(items) == 1:
                self.always[own] = whole[0]
            elif whole:
                self.at_end[own] = sorted(whole)
            for symbol in sorted({body[at] for _, body, at in items if at < len(body)}):
                self.step[own][symbol] = state_of(frozenset((h, b, at + 1) for h, b, at in items if at < len(b) and b[at] == symbol))
            return own

        self.first = state_of(frozenset((lhs, rhs, 0) for lhs, rhs in grammar if lhs == START))


class Node:
    """A stack top: a state and its links to the nodes below, each with the cost and audit of what lies between."""

    __slots__ = ("links", "state")

    def __init__(self, state: int):
        self.state = state
        self.links: dict[Node, tuple[int, str]] = {}


Frontier = dict[int, Node]


class Parser:
    """A graph-structured stack over an automaton."""

    def __init__(self, grammar: tuple[tuple[str, str], ...] = GRAMMAR, prices: Prices = Prices()):
        self.lr, self.prices = Automaton(grammar), prices
        self.stacks = self._stacks()

    def _stacks(self) -> list[tuple[int, ...]]:
        """Every stack of states that reading can leave, the empty one first; the grammar keeps them few."""
        found = [(self.lr.first,)]
        for stack in found:
            for symbol in self.lr.step[stack[-1]]:
                if symbol.islower():
                    top = self._shifted({stack[-1]: self._chain(stack)}, symbol, (0, ""))
                    found += [s for s, _ in self._paths(top) if s not in found]
                    if len(found) > 64:
                        raise ValueError("the grammar's stacks have no bound")
        return found

    @staticmethod
    def _chain(stack: tuple[int, ...]) -> Node:
        node = Node(stack[0])
        for state in stack[1:]:
            above = Node(state)
            above.links[node] = (0, "")
            node = above
        return node

    @staticmethod
    def _link(top: Frontier, state: int, below: Node, paid: tuple[int, str]) -> None:
        """Put a state on a node; of two equal links the smaller (cost, audit) stays."""
        if state not in top:
            top[state] = Node(state)
        links = top[state].links
        links[below] = min(paid, links.get(below, paid))

    def _reduced(self, top: Frontier, below: Node, paid: tuple[int, str], state: int) -> None:
        """Push a state, and reduce while that is all it can do."""
        if state not in self.lr.always:
            self._link(top, state, below, paid)
            return
        head, size = self.lr.always[state]
        for bottom, total in self._popped(below, size - 1, paid):
            self._reduced(top, bottom, total, self.lr.step[bottom.state][head])

    def _popped(self, node: Node, links: int, paid: tuple[int, str]) -> Iterator[tuple[Node, tuple[int, str]]]:
        if not links:
            yield node, paid
            return
        for below, (cost, audit) in node.links.items():
            yield from self._popped(below, links - 1, (cost + paid[0], audit + paid[1]))

    def _shifted(self, top: Frontier, symbol: str, paid: tuple[int, str], into: Frontier | None = None) -> Frontier:
        into = {} if into is None else into
        for node in top.values():
            if symbol in self.lr.step[node.state]:
                self._reduced(into, node, paid, self.lr.step[node.state][symbol])
        return into

    def _paths(self, top: Frontier) -> Iterator[tuple[tuple[int, ...], tuple[int, str]]]:
        """The stacks of a frontier with their cost and audit."""

        def down(node: Node) -> Iterator[tuple[tuple[int, ...], tuple[int, str]]]:
            if not node.links:
                yield (node.state,), (0, "")
            for below, (cost, audit) in node.links.items():
                for stack, paid in down(below):
                    yield (*stack, node.state), (paid[0] + cost, paid[1] + audit)

        for node in top.values():
            yield from down(node)

    def _best(self, top: Frontier) -> dict[tuple[int, ...], tuple[int, str]]:
        best: dict[tuple[int, ...], tuple[int, str]] = {}
        for stack, paid in self._paths(top):
            if stack not in best or paid < best[stack]:
                best[stack] = paid
        return best

    def _graph(self, best: dict[tuple[int, ...], tuple[int, str]]) -> Frontier:
        """A frontier of whole stacks: what is paid lies on each one's top link, so the stacks below are shared."""
        shared: dict[tuple[int, ...], Node] = {}
        top: Frontier = {}
        for stack, paid in best.items():
            below = Node(-1)  # the ground, below the first state
            for n in range(1, len(stack)):
                key = stack[:n]
                if key not in shared:
                    shared[key] = Node(stack[n - 1])
                below = shared[key]
                if n > 1:
                    below.links[shared[stack[: n - 1]]] = (0, "")
            self._link(top, stack[-1], below, paid)
        return top

    def inserted(self, best: dict) -> dict:
        """Stacks before the next row: any turns may be inserted."""
        todo = dict(best)
        while todo:
            new: Frontier = {}
            for symbol in GIVEN:
                self._shifted(self._graph(todo), symbol, (self.prices.insert, "I"), new)
            todo = {}
            for stack, paid in self._tidy(new).items():
                if stack not in best or paid < best[stack]:
                    todo[stack] = best[stack] = paid
        return best

    def _tidy(self, top: Frontier) -> dict:
        return {tuple(s for s in stack if s >= 0): paid for stack, paid in self._best(top).items()}

    def read(self, best: dict, symbol: str, must_go: bool, truncated: bool) -> dict:
        """Stacks after one row: deleted, kept or given another role."""
        ready = self.inserted(dict(best))
        out = {stack: (cost + self.prices.delete, audit + "D") for stack, (cost, audit) in ready.items()}
        if must_go:
            return out
        extra = self.prices.truncated if truncated else 0
        graph, new = self._graph(ready), {}
        for role in GIVEN:
            self._shifted(graph, role, (self.prices.rerole + extra, "R"), new)
        self._shifted(graph, symbol, (extra, "K"), new)
        for stack, paid in self._tidy(new).items():
            if stack not in out or paid < out[stack]:
                out[stack] = paid
        return out

    def accepted(self, best: dict) -> tuple[int, str]:
        """The least (cost, audit) of the stacks that inserted turns lead to the start symbol."""
        done = []
        for stack, paid in self.inserted(dict(best)).items():
            todo = [stack]
            while todo:
                now = todo.pop()
                for head, size in self.lr.at_end.get(now[-1], []):
                    left = now[: len(now) - size]
                    if head == START and len(left) == 1:
                        done.append(paid)
                    elif head != START:
                        todo.append((*left, self.lr.step[left[-1]][head]))
        return min(done)


@cache
def parser(prices: Prices = Prices()) -> Parser:
    return Parser(GRAMMAR, prices)


#: A row in one letter: its initial, in upper case where it is truncated; x and X are other initials, - must be deleted.
def chunk_paths(codes: str, every_start: bool, prices: Prices = Prices()) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, audit) between the stacks before and after a chunk; `to` -1 is the end of the conversation."""
    p, out = parser(prices), []
    for start, stack in enumerate(p.stacks if every_start else p.stacks[:1]):
        best = {stack: (0, "")}
        for code in codes:
            best = p.read(best, code.lower(), code == "-", code.isupper())
        out += [(start, p.stacks.index(s), cost, audit) for s, (cost, audit) in best.items()]
        out.append((start, -1, *p.accepted(best)))
    return out


def best_audits(chunks: list[tuple[list[int], list[int], list[int], list[str]]]) -> tuple[int, list[str]]:
    """The least (cost, audit) through the chunks of a conversation, the audit in slices."""
    ahead: dict[int, tuple[int, int]] = {}  # stack: (cost, rank of the audit from here to the end)
    moves: list[dict[int, int]] = []
    for i in range(len(chunks) - 1, -1, -1):
        last = i == len(chunks) - 1
        starts, ends, costs, audits = chunks[i]
        rank = {a: k for k, a in enumerate(sorted(set(audits)))}
        best: dict[int, tuple[int, int, int, int]] = {}
        for at, (start, end, cost, audit) in enumerate(zip(starts, ends, costs, audits, strict=True)):
            if last != (end == -1):
                continue
            then, tail = (0, 0) if last else ahead[end]
            now = (cost + then, rank[audit], tail, at)
            if start not in best or now < best[start]:
                best[start] = now
        order = {key: k for k, key in enumerate(sorted({b[1:3] for b in best.values()}))}
        ahead = {s: (b[0], order[b[1:3]]) for s, b in best.items()}
        moves.append({s: b[3] for s, b in best.items()})
    state, slices = 0, []
    for chunk, move in zip(chunks, reversed(moves), strict=True):
        at = move[state]
        slices.append(chunk[3][at])
        state = chunk[1][at]
    return ahead[0][0], slices


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with a fault in a fixed share of the rows, chosen by the checksum of `conv_id:turn`."""
    space = F.lit(" ")
    ids = [F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")]
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text"),
        (F.crc32(F.concat(ids[0], F.lit(":"), ids[1]).cast("binary")) % 20).alias("what"),
    ).filter("what <> 0")
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("what") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("what") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


_PLACE = ["conv_id", "turn", "role", "digest"]  # ascending, so nulls stand first
_NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_CHUNK_SCHEMA = (
    "conv_id long, pos long, turn long, role string, digest binary, firsts string, lasts string, first_turn long, "
    "last_turn long, turns long, blank long, duplicate long, truncated long, illegal long, starts array<int>, ends array<int>, costs array<long>, audits array<string>"
)


_KINDS = {
    "long": pa.int64(),
    "string": pa.string(),
    "binary": pa.binary(),
    "array<int>": pa.list_(pa.int32()),
    "array<long>": pa.list_(pa.int64()),
    "array<string>": pa.list_(pa.string()),
}


def _shape(schema: str) -> pa.Schema:
    return pa.schema([(name, _KINDS[kind]) for name, kind in (c.split() for c in schema.split(", "))])


def _keyed(rows: DataFrame) -> DataFrame:
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), digest.alias("digest"))


def _codes(rows: DataFrame) -> DataFrame:
    """pos, conv_id, turn, role, digest, code (see chunk_paths), fault of every row; pos is the row's place in the order."""
    solid = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    narrow = rows.select(
        "conv_id",
        "turn",
        "role",
        "digest",
        (F.length(solid) == 0).alias("is_blank"),
        (~F.right(solid, F.lit(1)).isin(".", "!", "?")).alias("is_cut"),
        F.monotonically_increasing_id().alias("tie"),
    )
    dealt = narrow.repartitionByRange(*_PLACE, "tie").sortWithinPartitions(*_PLACE, "tie")
    placed = table(dealt.drop("tie").withColumn("pos", F.monotonically_increasing_id()), "repair-rows")
    firsts = placed.groupBy("conv_id", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("is_first"))
    fault = F.when(F.col("is_blank"), "b").when(F.col("is_first").isNull(), "d").when(F.col("is_cut"), "t").otherwise("")
    initial = F.left("role", F.lit(1))
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    code = F.when(F.col("fault").isin("b", "d"), "-").when(F.col("fault") == "t", F.upper(letter)).otherwise(letter)
    return placed.join(firsts, "pos", "left").select("pos", "conv_id", "turn", "role", "digest", letter.alias("letter"), fault.alias("fault")).withColumn("code", code)


def _chunks(codes: DataFrame, prices: Prices) -> DataFrame:
    """One row per chunk of a conversation, cut where a range of rows ends and every CHUNK rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[str, bool], list] = {}
        held: list[dict] = []
        inside = True  # the first rows of a range may go on with a conversation of the range before

        def closed(rows: list[dict], every_start: bool) -> dict:
            codes, turns = "".join(r["code"] for r in rows), [r["turn"] for r in rows if r["turn"] is not None]
            key = (codes, every_start)
            paths = kept.get(key) or chunk_paths(*key, prices)
            if len(rows) <= 32:
                if len(kept) >= KEPT_CHUNKS:
                    kept.clear()
                kept[key] = paths
            letters, faults = "".join(r["letter"] for r in rows), [r["fault"] for r in rows]
            starts, ends, costs, audits = (list(c) for c in zip(*paths, strict=True))
            return {
                **{c: rows[0][c] for c in ("conv_id", "pos", "turn", "role", "digest")},
                "firsts": letters[0],
                "lasts": letters[-1],
                "first_turn": turns[0] if turns else None,
                "last_turn": turns[-1] if turns else None,
                "turns": sum(a != b for a, b in zip(turns, [None, *turns], strict=False)),
                **{name: faults.count(name[0]) for name in ("blank", "duplicate", "truncated")},
                "illegal": sum(a + b not in ADJACENT for a, b in zip(letters, letters[1:], strict=False)),
                **{"starts": starts, "ends": ends, "costs": costs, "audits": audits},
            }

        out: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and (row["conv_id"] != held[0]["conv_id"] or len(held) == CHUNK):
                    out.append(closed(held, inside))
                    inside = row["conv_id"] == held[0]["conv_id"]
                    held = []
                held.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=shape)
            out = []
        if held:
            yield pa.RecordBatch.from_pylist([closed(held, inside)], schema=shape)

    shape = _shape(_CHUNK_SCHEMA)
    return codes.repartitionByRange("pos").sortWithinPartitions("pos").mapInArrow(run, _CHUNK_SCHEMA)


def _slices(chunks: DataFrame) -> DataFrame:
    """The chosen audit of every chunk, and the numbers of its conversation with the first."""

    def chosen(rows: list[dict]) -> list[dict]:
        cost, audits = best_audits([(r["starts"], r["ends"], r["costs"], r["audits"]) for r in rows])
        stated = [r for r in rows if r["turns"]]
        turns = sum(r["turns"] for r in stated) - sum(a["last_turn"] == b["first_turn"] for a, b in zip(stated, stated[1:], strict=False))
        gaps = stated[-1]["last_turn"] - stated[0]["first_turn"] + 1 - turns if stated else 0
        illegal = sum(r["illegal"] for r in rows) + sum(a["lasts"] + b["firsts"] not in ADJACENT for a, b in zip(rows, rows[1:], strict=False))
        numbers = [gaps, *(sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated")), illegal, cost]
        keep = ("conv_id", "turn", "role", "digest", "pos")
        return [{**{c: r[c] for c in keep}, "audit": audit, "numbers": None if k else numbers} for k, (r, audit) in enumerate(zip(rows, audits, strict=True))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, out = (row for batch in batches for row in batch.to_pylist()), []
        for _, rows in groupby(every, key=lambda r: r["conv_id"]):
            out += chosen(list(rows))
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_pylist(out, schema=shape)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema=shape)

    schema = "conv_id long, turn long, role string, digest binary, pos long, audit string, numbers array<long>"
    shape = _shape(schema)
    return chunks.repartition("conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(run, schema)


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """("start", conv_id, numbers), then ("edit", kind, role, text) in order, then ("end", conv_id, audit) of each conversation.

    A conversation's slices of the audit come no later than the rows that they are for. The roles follow from the
    grammar: after a system turn that stays, if there is one, user and assistant alternate.
    """
    waiting: deque[str] = deque()  # edits not yet done, slice by slice
    at, pairs, audit, now, is_open = 0, 0, [], None, False

    def next_edit() -> str:
        nonlocal at
        while at >= len(waiting[0]):
            waiting.popleft()
            at = 0
        at += 1
        return waiting[0][at - 1]

    def closing() -> Iterator[tuple]:
        nonlocal pairs
        for _ in range(sum(map(len, waiting)) - at):
            yield "edit", next_edit(), ("user", "assistant")[pairs % 2], ""
            pairs += 1
        yield "end", now, "".join(audit)

    for batch in batches:
        for row in batch.to_pylist():
            if row["kind"] == 0:
                if is_open:
                    yield from closing()
                now, is_open, at, pairs = row["conv_id"], True, 0, 0
                waiting.clear()
                audit.clear()
            elif row["kind"] == 1:
                if row["numbers"] is not None:
                    yield "start", now, row["numbers"]
                waiting.append(row["audit"])
                audit.append(row["audit"])
            else:
                while (edit := next_edit()) == "I":
                    yield "edit", "I", ("user", "assistant")[pairs % 2], ""
                    pairs += 1
                if edit == "D":
                    yield "edit", "D", row["role"], row["text"]
                elif edit == "K" and row["role"].startswith("s"):
                    yield "edit", "K", row["role"], row["text"]
                else:
                    yield "edit", edit, row["role"] if edit == "K" else ("user", "assistant")[pairs % 2], row["text"]
                    pairs += 1
    if is_open:
        yield from closing()


def _aligned(conversations: DataFrame, rows: DataFrame, prices: Prices) -> DataFrame:
    """Heads, audit slices and rows of each conversation in one order, ready to be read once."""
    keyed = _keyed(rows)
    slices = _slices(_chunks(_codes(keyed), prices))
    none = F.lit(None)
    heads = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    parts = [
        heads.select("conv_id", none.cast("long").alias("turn"), F.lit("").alias("role"), F.lit(b"").alias("digest"), F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("pos"), none.cast("string").alias("text"), none.cast("string").alias("audit"), none.cast("array<long>").alias("numbers")),
        slices.select("conv_id", "turn", "role", "digest", F.lit(1).alias("kind"), "pos", none.cast("string").alias("text"), "audit", "numbers"),
        keyed.select("conv_id", "turn", "role", "digest", F.lit(2).alias("kind"), F.lit(0).cast("long").alias("pos"), "text", none.cast("string").alias("audit"), none.cast("array<long>").alias("numbers")),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    order = ["conv_id", F.col("kind") != 0, *_PLACE[1:], "kind", "pos"]
    return every.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "kind", "role", "text", "audit", "numbers")


def summaries(conversations: DataFrame, rows: DataFrame, prices: Prices = Prices()) -> DataFrame:
    """Faults, cheapest cost, audit and the hash of the repaired turns for every conversation id of `conversations`; `rows` are its turns to be repaired."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        numbers, any_turn, digest = [0] * 6, False, hashlib.sha256()
        for event, first, *more in _edits(batches):
            if event == "start":
                numbers = more[0]
            elif event == "edit" and first != "D":
                role, text = more
                digest.update(("\n" if any_turn else "").encode() + f"{role}:{text}".encode())
                any_turn = True
            elif event == "end":
                out.append((first, *numbers, more[0], digest.hexdigest()))
                numbers, any_turn, digest = [0] * 6, False, hashlib.sha256()
                if len(out) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    names = ["conv_id", *_NUMBERS, "audit", "repaired_sha256"]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    return _aligned(conversations, rows, prices).mapInArrow(run, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def repaired(rows: DataFrame, prices: Prices = Prices()) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), role, text, edit (K, R or I) of every turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv, place, size = None, 0, 0
        for event, first, *more in _edits(batches):
            if event == "start":
                conv, place = first, 0
            elif event == "edit" and first != "D":
                out.append((conv, place, more[0], more[1], first))
                place, size = place + 1, size + len(more[1])
                if len(out) >= 10_000 or size > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    names, kinds = ["conv_id", "place", "role", "text", "edit"], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    return _aligned(rows, rows, prices).mapInArrow(run, "conv_id long, place long, role string, text string, edit string")
