"""Repair of conversation structure by weighted finite-state composition.

Three machines are composed: the input acceptor, a chain with one arc per turn; the edit transducer, which keeps
a turn, gives it another role, deletes it or inserts an empty one, each at a cost; and the acceptor of role
initials ``(s?(ua)+)?``. The composition is built lazily, state by state as the turns arrive: its states after a
turn are grammar states, four at most. A path weighs (cost, labels), compared in this order, and the shortest one
in topological order is the repair. Two insertions at one place are enough: a third comes back to a grammar
state that was there before at less cost, so the composed machine has no cycle.

Labels are never stored as strings while paths compete. After a turn the living paths are ranked; a longer
path compares by its origin's rank and the labels since. No path's labels begin another's there: all have one
label other than I for each turn, and the last is such a one. What remains is four bytes a turn of back pointers
for one conversation; its audit needs one byte a turn anyway.

Shape at scale: copies of a turn are found by an aggregate over (conversation, role, digest), so no task keeps
what it has seen. Small rows without texts then come to one task per conversation, sorted and as a stream.
``repaired`` streams the texts in the same order behind the conversation's audit. A conversation is the
unit of both, since an edit depends on all its turns; a source or text that is frequent is not.

Defined results: null role or text: one space; turns are ordered by number (nulls first), then role, then SHA-256
of the text; repeated rows: duplicates but for the first; a null conversation id is one conversation; an empty
table: no rows; a turn without any role initial of the grammar can be kept nowhere; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What edits cost, the white space, and the ends of a whole text.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
SPACE, ENDS = " \t\n\x0b\x0c\r", ".!?"

#: The acceptor of ``(s?(ua)+)?``: state -> role initial -> state.
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
FINAL = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
NONE, BLANK, DUPLICATE, CUT = range(4)
MOST_INSERTS = 2
PLANS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
REPAIRED = "conv_id long, position long, role string, text string, edit string"


@lru_cache(maxsize=1024)
def arcs(state: int, initial: str, fault: int) -> tuple[tuple[int, str, int], ...]:
    """(cost, label, next state) of the composed arcs that read a turn in a grammar state."""
    step, out = GRAMMAR[state], [(DELETE, "D", state)]
    if fault in (NONE, CUT):
        more = TRUNCATED if fault == CUT else 0
        if initial in step:
            out.append((KEEP + more, "K", step[initial]))
        out += [(REROLE + more, "R", step[x]) for x in ROLES if x in step]
    return tuple(out)


#: Insertions: state -> states, the transducer's arcs that read nothing.
INSERTS = {g: tuple(step[x] for x in ROLES if x in step) for g, step in GRAMMAR.items()}
LABELS = ["I" * k + x for k in range(MOST_INSERTS + 1) for x in "DKR"]
CODE = {(rank, x): rank * len(LABELS) + k for rank in range(4) for k, x in enumerate(LABELS)}


class Paths:
    """The shortest paths to all states of the composed machine, turn by turn."""

    def __init__(self) -> None:
        self.now = [(0, 0)]  # (cost, grammar state) of the living paths, by rank of their labels
        self.back = bytearray()

    def _inserted(self) -> dict[int, tuple[int, int, str]]:
        """Grammar state -> (cost, rank, labels since the last turn)."""
        best = {g: (cost, rank, "") for rank, (cost, g) in enumerate(self.now)}
        front = dict(best)
        for _ in range(MOST_INSERTS):
            reached: dict[int, tuple[int, int, str]] = {}
            for g, (cost, rank, tail) in front.items():
                for to in INSERTS[g]:
                    way = (cost + INSERT, rank, tail + "I")
                    if to not in best or way < best[to]:
                        best[to] = reached[to] = way
            front = reached
        return best

    def add(self, initial: str, fault: int) -> None:
        best: dict[int, tuple[int, int, str]] = {}
        for g, (cost, rank, tail) in self._inserted().items():
            for more, label, to in arcs(g, initial, fault):
                way = (cost + more, rank, tail + label)
                if to not in best or way < best[to]:
                    best[to] = way
        ranked = sorted((way[1:], way[0], to) for to, way in best.items())
        self.now = [(cost, to) for _, cost, to in ranked]
        codes = bytearray(4)
        for k, (labels, _, _) in enumerate(ranked):
            codes[k] = CODE[labels]
        self.back += codes

    def finish(self) -> tuple[int, str]:
        """(cost, labels) of the shortest path to a final state."""
        cost, rank, tail = min(way for g, way in self._inserted().items() if g in FINAL)
        out = [tail]
        for at in range(len(self.back) - 4, -1, -4):
            code = self.back[at + rank]
            rank, k = divmod(code, len(LABELS))
            out.append(LABELS[k])
        return cost, "".join(reversed(out))


def shortest(turns: list[tuple[str, int]]) -> tuple[int, str]:
    """(cost, audit) of a list of (role initial, fault)."""
    paths = Paths()
    for initial, fault in turns:
        paths.add(initial, fault)
    return paths.finish()


class _Conversation:
    def __init__(self, conv_id: int | None) -> None:
        self.id, self.paths = conv_id, Paths()
        self.faults = [0, 0, 0, 0]
        self.first = self.turn = self.initial = self.row = None
        self.turns = self.illegal = 0

    def add(self, turn: int | None, initial: str, blank: bool, cut: bool, row: tuple, seen: bool | None) -> None:
        """``seen``: None if no other turn says the same, else whether one with a smaller number does."""
        duplicate = seen is not None and (seen or row == self.row)
        fault = BLANK if blank else DUPLICATE if duplicate else CUT if cut else NONE
        self.faults[fault] += 1
        self.illegal += self.row is not None and self.initial + initial not in ("su", "ua", "au")
        if turn is not None and turn != self.turn:
            self.first, self.turn, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        self.initial, self.row = initial, row
        self.paths.add(initial, fault)

    def result(self) -> tuple:
        gaps = 0 if self.first is None else self.turn - self.first + 1 - self.turns
        return (self.id, gaps, *self.faults[1:], self.illegal, *self.paths.finish())


def _table(rows: list[tuple], names: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [x.split() for x in names.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.record_batch([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _plans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: _Conversation | None = None
    for b in batches:
        done = []
        columns = ("conv_id", "turn", "initial", "blank", "cut", "role", "digest", "seen")
        for conv, turn, initial, blank, cut, role, digest, seen in zip(*(b.column(c).to_pylist() for c in columns), strict=True):
            if now is None or now.id != conv:
                if now is not None:
                    done.append(now.result())
                now = _Conversation(conv)
            now.add(turn, initial, blank, cut, (turn, role, digest), seen)
        yield _table(done, PLANS)
    if now is not None:
        yield _table([now.result()], PLANS)


def _rows(turns: DataFrame) -> DataFrame:
    said = F.coalesce(F.col("text"), F.lit(" "))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit(" ")).alias("role"), said.alias("text"))
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))


def plans(turns: DataFrame) -> DataFrame:
    """Per conversation: gaps in the numbers, first faults of its turns, illegal neighbours, cost and audit of the cheapest repair."""
    trimmed = F.rtrim(F.col("text"), F.lit(SPACE))
    rows = _rows(turns).select("conv_id", "turn", "role", "digest", F.left("role", F.lit(1)).alias("initial"), (trimmed == "").alias("blank"), (~F.right(trimmed, F.lit(1)).isin(*ENDS)).alias("cut"))
    again = rows.groupBy("conv_id", "role", "digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("first")).where("n > 1")
    again = again.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.col("first.turn").alias("first_turn"), F.lit(True).alias("shared"))
    rows = rows.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    rows = rows.withColumn("seen", F.when(F.col("shared"), ~F.col("turn").eqNullSafe(F.col("first_turn"))))
    rows = rows.select("conv_id", "turn", "initial", "blank", "cut", "role", "digest", "seen")
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "digest")]
    return rows.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_plans, PLANS)


class _Applied:
    """The turns that an audit leaves of a conversation, as they stream by."""

    def __init__(self, conv_id: int | None, audit: str) -> None:
        self.id, self.audit, self.at, self.state, self.n = conv_id, audit, 0, 0, 0

    def _said(self, initial: str, role: str, text: str, edit: str) -> tuple:
        self.state = GRAMMAR[self.state][initial]
        self.n += 1
        return (self.id, self.n - 1, role, text, edit)

    def inserted(self) -> Iterator[tuple]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            initial = next(x for x in ROLES if x in GRAMMAR[self.state])
            yield self._said(initial, ROLES[initial], "", "I")

    def add(self, role: str, text: str) -> Iterator[tuple]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            yield self._said(role[0], role, text, edit)
        elif edit == "R":
            initial = next(x for x in ROLES if x in GRAMMAR[self.state])
            yield self._said(initial, ROLES[initial], text, edit)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: _Applied | None = None
    for b in batches:
        out: list[tuple] = []
        for conv, audit, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text")), strict=True):
            if audit is not None:
                if now is not None:
                    out += now.inserted()
                now = _Applied(conv, audit)
            else:
                out += now.add(role, text)
        yield _table(out, REPAIRED)
    if now is not None:
        yield _table(list(now.inserted()), REPAIRED)


def repaired(turns: DataFrame, made: DataFrame) -> DataFrame:
    """The turns after the repair ``made`` (a table of ``plans``), in order within a partition.

    ``edit`` tells what became of the turn: K, R or I. Conversations of which nothing is left have no rows.
    """
    none = F.lit(None).cast("string")
    rows = _rows(turns).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "digest", none.alias("audit"))
    heads = made.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), none.alias("role"), none.alias("text"), F.lit(None).cast("binary").alias("digest"), "audit")
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "kind", "turn", "role", "digest")]
    both = rows.unionByName(heads).repartition("conv_id").sortWithinPartitions(*order)
    return both.select("conv_id", "audit", "role", "text").mapInArrow(_apply, REPAIRED)
