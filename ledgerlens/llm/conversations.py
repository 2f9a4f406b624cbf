"""Repair of conversation structure by a Viterbi search that streams.

The rows of a conversation, in order, become a sequence of roles that reads
``(s?(ua)+)?`` by initials. Each row is kept, given another role, or deleted, and rows may
be inserted; the cheapest edits win, of equal ones the ASCII-least string of initials.

The search keeps one survivor for each state of that pattern. Survivors share a tree of
backpointers with reference counts; branches that no survivor reaches are freed, and once
all survivors have an ancestor in common, the edits up to it are certain and go out. So
memory holds the rows that are still undecided, not the conversation. Equal costs are
decided by comparing the undecided suffixes from where they part.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
#: What a row costs more that stays although its end is missing.
TRUNCATED = 3

#: States: nothing yet, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
ACCEPTED = (START, ASSISTANT)
FOLLOWS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: The role that a row must take, or an inserted row has, in each state.
WANTED = ("user", "user", "assistant", "user")
LEGAL = ("su", "ua", "au")

#: EXTRA[y][x]: what state y costs at most above state x for all rows still to come. From
#: y, a system row that x would keep is deleted (4), and what y lacks is inserted (3 each).
#: A survivor x that lies more than this above some y cannot win, whatever comes.
EXTRA = ((0, 0, 3, 0), (6, 0, 3, 6), (7, 3, 0, 3), (4, 0, 3, 0))

SPACE = " \t\n\x0b\x0c\r"


class Node:
    """An edit on the way to survivors; ``refs`` counts its children and survivors."""

    __slots__ = ("parent", "edit", "depth", "refs")

    def __init__(self, parent: Node | None, edit: str):
        self.parent, self.edit, self.refs = parent, edit, 0
        self.depth = 0 if parent is None else parent.depth + 1
        if parent is not None:
            parent.refs += 1


def less(a: Node, b: Node) -> bool:
    """Whether the edits up to ``a`` come before those up to ``b``. Both cover the same rows at
    the same cost and end in the same state, so neither can be the beginning of the other."""
    left, right = [], []
    while a is not b:
        if a.depth >= b.depth:
            left.append(a.edit)
            deeper, a = a, a.parent
            if deeper.depth == b.depth:
                right.append(b.edit)
                b = b.parent
        else:
            right.append(b.edit)
            b = b.parent
    return left[::-1] < right[::-1]


class Viterbi:
    """Survivors over the rows so far; decided edits go to ``emit``, in order."""

    def __init__(self, emit: Callable[[str], None]):
        self.emit = emit
        self.root = Node(None, "")
        self.root.refs = 1
        self.survivors: list[tuple[int, Node] | None] = [(0, self.root), None, None, None]

    def _free(self, node: Node) -> None:
        """One reference less; what nothing refers to goes, up to a node still in use."""
        node.refs -= 1
        while node.refs == 0 and node.parent is not None:
            node = node.parent
            node.refs -= 1

    def _offer(self, layer: list, state: int, cost: int, parent: Node, edit: str) -> bool:
        """Let a path compete for a state of ``layer``."""
        held = layer[state]
        if held is not None and held[0] < cost:
            return False
        node = Node(parent, edit)
        node.refs = 1
        if held is not None and held[0] == cost and not less(node, held[1]):
            self._free(node)
            return False
        layer[state] = (cost, node)
        if held is not None:
            self._free(held[1])
        return True

    def _insert(self) -> None:
        """Inserted rows, wherever they help or tie, at the present place."""
        changed = True
        while changed:
            changed = False
            for state in STATES:
                if (held := self.survivors[state]) is not None:
                    after = FOLLOWS[state][WANTED[state][0]]
                    best = self.survivors[after]
                    # The path itself, offered again, is no change.
                    if best is not None and best[1].parent is held[1] and best[1].edit == INSERT:
                        continue
                    changed |= self._offer(self.survivors, after, held[0] + COST[INSERT], held[1], INSERT)

    def push(self, initial: str, doomed: bool, truncated: bool) -> None:
        """The next row: its role's initial, whether it must go, whether its end is missing."""
        self._insert()
        before, layer = self.survivors, [None] * 4
        extra = TRUNCATED if truncated else 0
        for state in STATES:
            if before[state] is None:
                continue
            cost, node = before[state]
            self._offer(layer, state, cost + COST[DELETE], node, DELETE)
            if doomed:
                continue
            follows = FOLLOWS[state]
            if initial in follows:
                self._offer(layer, follows[initial], cost + COST[KEEP] + extra, node, KEEP)
            if (wanted := WANTED[state][0]) != initial:
                self._offer(layer, follows[wanted], cost + COST[REROLE] + extra, node, REROLE)
        for x in STATES:
            if layer[x] and any(layer[y] and layer[y][0] + EXTRA[y][x] < layer[x][0] for y in STATES):
                self._free(layer[x][1])
                layer[x] = None
        self.survivors = layer
        for held in before:
            if held is not None:
                self._free(held[1])
        self._settle()

    def _settle(self) -> None:
        """Emit what all survivors share."""
        if self.root.refs > 1:
            return
        node = next(held[1] for held in self.survivors if held is not None)
        path = []
        while node is not self.root:
            path.append(node)
            node = node.parent
        while path and self.root.refs == 1:
            self.root = path.pop()
            self.root.parent = None
            self.emit(self.root.edit)

    def finish(self) -> int:
        """Emit the rest of the best path that ends in an accepted state; its cost."""
        self._insert()
        best: tuple[int, Node] | None = None
        for state in ACCEPTED:
            held = self.survivors[state]
            if held and (best is None or held[0] < best[0] or held[0] == best[0] and less(held[1], best[1])):
                best = held
        path, node = [], best[1]
        while node is not self.root:
            path.append(node.edit)
            node = node.parent
        for edit in reversed(path):
            self.emit(edit)
        return best[0]


def faults(text: str, repeated: bool) -> str | None:
    """The first fault of a row: blank, duplicate or truncated."""
    shown = text.rstrip(SPACE)
    if not shown:
        return "blank"
    if repeated:
        return "duplicate"
    return None if shown[-1] in ".!?" else "truncated"


class Conversation:
    """One conversation, row by row. ``row_out`` gets every edit with its row: (edit, turn,
    role, text), the role as repaired, nulls for the turn of an inserted row."""

    def __init__(self, row_out: Callable[[tuple], None] | None = None):
        self.row_out = row_out
        self.waiting: deque[tuple] = deque()
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.turns = 0
        self.first = self.last = self.previous = None
        self.state, self.audit, self.written = START, [], False
        self.digest = hashlib.sha256()
        self.viterbi = Viterbi(self._edit)

    def push(self, turn: int | None, role: str, text: str, repeated: bool) -> None:
        fault = faults(text, repeated)
        if fault:
            self.counts[fault] += 1
        initial = role[:1]
        if self.previous is not None and self.previous + initial not in LEGAL:
            self.illegal += 1
        self.previous = initial
        if turn is not None and turn != self.last:  # rows come by turn
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1
        self.waiting.append((turn, role, text))
        self.viterbi.push(initial, fault in ("blank", "duplicate"), fault == "truncated")

    def _edit(self, edit: str) -> None:
        self.audit.append(edit)
        turn, role, text = (None, "", "") if edit == INSERT else self.waiting.popleft()
        if edit in (INSERT, REROLE):
            role = WANTED[self.state]
        if edit != DELETE:
            self.state = FOLLOWS[self.state][role[:1]]
            line = f"{role}:{text}".encode("utf-8", "surrogatepass")
            self.digest.update(b"\n" + line if self.written else line)
            self.written = True
        if self.row_out:
            self.row_out((edit, turn, role, text))

    def finish(self) -> dict:
        """Emit what is undecided; the summary of the conversation."""
        cost = self.viterbi.finish()
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return {
            "gaps": gaps, **self.counts, "illegal": self.illegal, "cost": cost,
            "audit": "".join(self.audit), "repaired_sha256": self.digest.hexdigest(),
        }


ORDERED = ("conv_id", "turn", "role", "text", "repeated", "present")
SUMMARY = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired_sha256 string"
)
REPAIRED = "conv_id long, position long, edit string, turn long, role string, text string"


def _arrow(ddl: str) -> pa.Schema:
    """The same columns for Arrow."""
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def _in_order(rows: DataFrame) -> DataFrame:
    """Rows of one conversation behind one another, by turn (nulls first), role and text, each
    with whether its role and text were there before; ``present`` false marks a row that only
    names its conversation."""
    held = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"), "present",
    )
    seen = Window.partitionBy("conv_id", "present", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    # Rows are dealt by conversation; the window and the sort then stay within partitions,
    # where they can spill.
    return (
        held.repartition("conv_id")
        .withColumn("repeated", F.row_number().over(seen) > 1)
        .select(*ORDERED)
        .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "repeated")
    )


def _streamed(batches: Iterator[pa.RecordBatch], begin: Callable, end: Callable) -> Iterator[None]:
    """Feed sorted rows to a ``Conversation`` each, which batches do not cut. Yields after every
    batch, so that the caller can hand on what has gathered."""
    current, talk = None, None
    for batch in batches:
        held = batch.to_pydict()
        for key, turn, role, text, repeated, present in zip(*(held[c] for c in ORDERED), strict=True):
            if talk is None or key != current:
                if talk is not None:
                    end(current, talk)
                current, talk = key, begin(key)
            if present:
                talk.push(turn, role, text, repeated)
        yield
    if talk is not None:
        end(current, talk)
        yield


def summarize(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text, present): ``SUMMARY``.

    A row with ``present`` false only names its conversation; one without any other row has
    zeros, no edits and the digest of nothing. A null conv_id is a conversation of its own,
    a null turn comes first, a null role or text is one space. Rows repeated in full are
    duplicates of the first. An empty table gives an empty one.

    Rows are shuffled once, by conversation. A conversation streams through one task, since
    its digest is a chain over all of its text: a batch and the undecided rows are held, and
    the audit, a letter a row. Sorts spill.
    """

    schema = _arrow(SUMMARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for _ in _streamed(batches, lambda _: Conversation(), lambda key, talk: out.append({"conv_id": key, **talk.finish()})):
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()

    return _in_order(rows).mapInArrow(run, SUMMARY)


def repaired(rows: DataFrame, deleted: bool = False) -> DataFrame:
    """The repaired rows of every conversation: ``REPAIRED``, by conv_id and position (from 1),
    with the edit that made them; with ``deleted`` also the rows that went. Nulls, repeated
    rows and empty tables as in ``summarize``."""

    schema = _arrow(REPAIRED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        at = 0

        def begin(key):
            nonlocal at
            at = 0

            def row_out(row: tuple) -> None:
                nonlocal at
                if row[0] != DELETE:
                    at += 1
                if deleted or row[0] != DELETE:
                    out.append(dict(zip(schema.names, (key, at, *row), strict=True)))

            return Conversation(row_out)

        for _ in _streamed(batches, begin, lambda _, talk: talk.finish()):
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()

    return _in_order(rows).mapInArrow(run, REPAIRED)


def _or_space(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` with faults by a hash of conversation and turn, as input of a repair: of twenty
    parts one is dropped, one emptied, one loses its sentence ends, one is repeated and one
    gets the role of a user. Nulls of role and text become one space. Dropped rows stay with
    ``present`` false and no text."""
    part = F.crc32(F.concat_ws(":", _or_space("conv_id"), _or_space("turn")).cast("binary")) % 20
    text = F.when(part.isin(0, 1), "").when(part == 2, F.regexp_replace(_or_space("text"), "[.!?]", "")).otherwise(_or_space("text"))
    copies = F.when(part == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", "turn", F.when(part == 4, "user").otherwise(_or_space("role")).alias("role"), text.alias("text"),
        (part != 0).alias("present"), F.explode(copies).alias("copy"),
    ).drop("copy")
