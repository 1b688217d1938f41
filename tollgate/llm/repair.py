"""Repair of the turn structure of conversations by weighted interval parsing.

Rows are first damaged by a hash of conversation and turn, so that there is something to repair. A repaired conversation has role
initials `(s?(ua)+)?`. Its automaton has the states 0 (nothing yet), 1 (after a system row), 2 (after a user row) and 3 (after an
assistant row); a nonterminal [p, q] derives the spans of rows whose kept roles lead from p to q. The grammar is in Chomsky normal
form: [p, q] -> [p, r] [r, q] over two neighbouring spans, and [p, q] -> row for one row that is kept, given another role or
deleted. Insertions have spans of no rows; every cell of one row is closed under them on both sides, and so is every join of closed
cells. A cell holds the least (cost, audit). Since every derivation from p to q splits at every border, cells of twice the length
come from one border each, bottom-up by span length, and spans of different tasks can be joined.

Two audits of one span and one cost are never prefixes of each other (what follows the prefix would be insertions, which cost), so
the least audit of a joined span is the least of the joined least audits.

Equal rows of one turn are counted before they are shuffled. Rows are dealt by ranges of (conversation, turn, role, beginning of the
text), so a long conversation lies in many tasks; each returns one cell for its part. Duplicates are found by one aggregate over (role,
text). Only the digest of the repaired rows reads a conversation in one stream, without holding it; its audit, one letter a row, is held.

Nulls of role and text are one space, and so are nulls in the hashed key. Rows with a null turn come first and count for no gap. Rows
of one turn are ordered by role and text, in bytes. A null conv_id is a conversation of its own. An empty role, which has no initial,
is never kept. Other columns are not read. A conversation without rows after the damage has zeros, no audit and the digest of no bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.llm.common import parts, stored

# The automaton, the prices of the edits, the role that follows each state, white space.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FINAL = (0, 3)
DELETE, REROLE, INSERT, CUT_OFF = 2, 1, 5, 5
ROLES = {"u": "user", "a": "assistant"}
BLANKS = " \t\n\v\f\r"
LEGAL = ("su", "ua", "au")

Cell = dict[tuple[int, int], tuple[int, str]]

PART = ("conv_id bigint, part int, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, "
        "low bigint, high bigint, turns bigint, cell array<struct<p:int,q:int,cost:bigint,audit:string>>")
RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


# ---- cells ------------------------------------------------------------------------------------------

def joined(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans."""
    out: Cell = {}
    for (p, r), (cost, audit) in left.items():
        for (r2, q), (more, rest) in right.items():
            if r == r2:
                made = (cost + more, audit + rest)
                if (p, q) not in out or made < out[p, q]:
                    out[p, q] = made
    return out


def closed_empty() -> Cell:
    """The cell of no rows: all insertions that lead from one state to another."""
    out: Cell = {(p, p): (0, "") for p in range(4)}
    for _ in range(4):
        for (p, r), (cost, audit) in list(out.items()):
            for (r2, initial), q in STEPS.items():
                if r2 == r and initial in ROLES:
                    out[p, q] = min(out.get((p, q), (1 << 60, "")), (cost + INSERT, audit + "I"))
    return out


EMPTY = closed_empty()


def row_cell(initial: str, dropped: bool, cut_off: bool) -> Cell:
    """The closed cell of one row."""
    out: Cell = {(p, p): (DELETE, "D") for p in range(4)}
    for (p, step), q in () if dropped else STEPS.items():
        options = [(0, "K")] if step == initial else [(REROLE, "R")] if step in ROLES else []
        out.update({(p, q): (cost + CUT_OFF * cut_off, edit) for cost, edit in options})
    return joined(joined(EMPTY, out), EMPTY)


ROW_CELLS = {(i, d, c): row_cell(i, d, c) for i in ("s", "u", "a", "") for d in (False, True) for c in (False, True)}


class Spans:
    """Joins the cells of successive rows, always two spans of equal length, so few are open at any time."""

    def __init__(self) -> None:
        self.open: list[tuple[int, Cell]] = []

    def add(self, cell: Cell, size: int = 1) -> None:
        while self.open and self.open[-1][0] <= size:
            more, left = self.open.pop()
            cell, size = joined(left, cell), size + more
        self.open.append((size, cell))

    def cell(self) -> Cell:
        out: Cell | None = None
        for _, left in reversed(self.open):
            out = left if out is None else joined(left, out)
        return EMPTY if out is None else out


def repeated(cell: Cell, copies: int) -> Cell:
    """The cell of `copies` equal rows, by doubling."""
    out: Cell | None = None
    while copies:
        if copies & 1:
            out = cell if out is None else joined(cell, out)
        copies >>= 1
        if copies:
            cell = joined(cell, cell)
    return out or EMPTY


def cheapest(cell: Cell) -> tuple[int, str]:
    return min(cell[0, q] for q in FINAL if (0, q) in cell)


# ---- passes over sorted rows --------------------------------------------------------------------------

def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


class Part:
    """What one task knows of one conversation."""

    def __init__(self, conv: int | None) -> None:
        self.conv, self.counts, self.spans = conv, [0, 0, 0, 0], Spans()
        self.first = self.last = self.low = self.high = None
        self.turns = 0

    def add(self, turn, initial, blank, fresh, cut_off, copies) -> None:
        self.counts[0] += copies if blank else 0
        self.counts[1] += 0 if blank else copies - fresh
        self.counts[2] += bool(fresh and cut_off)
        self.counts[3] += copies - 1 + (self.last is not None and self.last + initial not in LEGAL)
        self.first, self.last = initial if self.first is None else self.first, initial
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        kind = initial if initial in ("s", "u", "a") else ""
        if fresh:
            self.spans.add(ROW_CELLS[kind, False, cut_off])
        if copies > fresh:
            self.spans.add(repeated(ROW_CELLS[kind, True, False], copies - fresh), copies - fresh)

    def record(self, part: int) -> tuple:
        cell = [{"p": p, "q": q, "cost": cost, "audit": audit} for (p, q), (cost, audit) in self.spans.cell().items()]
        return (self.conv, part, *self.counts, self.first, self.last, self.low, self.high, self.turns, cell)


def written(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)


def arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def batched(rows: Iterator[tuple], schema: pa.Schema, limit: int = 1024) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == limit:
            yield written(held, schema)
            held = []
    if held:
        yield written(held, schema)


def parse_parts(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One record for every conversation in this task's range of sorted rows."""
    number = TaskContext.get().partitionId()

    def found():
        part = None
        for conv, *row in rows_of(batches):
            if part is None or part.conv != conv:
                if part is not None:
                    yield part.record(number)
                part = Part(conv)
            part.add(*row)
        if part is not None:
            yield part.record(number)

    return batched(found(), schema)


def join_parts(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The result of every conversation from its parts in order. Only cells that begin in state 0 are carried on."""
    def found():
        at, known = None, False

        def done():
            gaps = high - low + 1 - turns if low is not None else 0
            return (at, gaps, *counts, *cheapest(cell))

        for conv, part, *counts_, first, last_, low_, high_, turns_, spans in rows_of(batches):
            if not known or conv != at:
                if known:
                    yield done()
                at, known, counts, last, low, high, turns = conv, True, [0, 0, 0, 0], None, None, None, 0
                cell: Cell = {k: v for k, v in EMPTY.items() if k[0] == 0}
            if part < 0:
                continue
            counts = [a + b for a, b in zip(counts, counts_)]
            counts[3] += last is not None and last + first not in LEGAL
            last = last_
            turns += turns_ - (high is not None and high == low_)
            low, high = low_ if low is None else low, high_ if high_ is not None else high
            cell = joined(cell, {(x["p"], x["q"]): (x["cost"], x["audit"]) for x in spans})
        if known:
            yield done()

    return batched(found(), schema)


def digest(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Digests of the repaired rows: of every conversation first the row with its audit, then its rows in order."""
    def found():
        audit, head, hashed, state, lines = "", None, None, 0, 0

        def say(role: str, text: str) -> None:
            nonlocal lines
            hashed.update((("\n" if lines else "") + role + ":" + text).encode())
            lines += 1

        def insert_up_to(place: int) -> int:
            nonlocal state
            while place < len(audit) and audit[place] == "I":
                step = "a" if state == 2 else "u"
                say(ROLES[step], "")
                state, place = STEPS[state, step], place + 1
            return place

        for conv, _, role, text, copies, *result in rows_of(batches):
            if role is None:
                if head is not None:
                    insert_up_to(place)
                    yield (*head, hashed.hexdigest())
                head, audit, hashed, state, lines, place = (conv, *result), result[-1], hashlib.sha256(), 0, 0, 0
                continue
            for _ in range(copies):
                place = insert_up_to(place)
                edit, place = audit[place], place + 1
                if edit != "D":
                    step = role[0] if edit == "K" else "a" if state == 2 else "u"
                    say(role if edit == "K" else ROLES[step], text)
                    state = STEPS[state, step]
        if head is not None:
            insert_up_to(place)
            yield (*head, hashed.hexdigest())

    return batched(found(), schema)


# ---- jobs -----------------------------------------------------------------------------------------------

def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies after the damage; equal rows of one turn are one row."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(key) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return (conversations.where(kind != 0).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 3, 2).otherwise(1).cast("long").alias("copies"))
        .groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")))


def shown(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANKS))


def with_faults(rows: DataFrame) -> DataFrame:
    """`rows` with blank, fresh (1 if the first of the copies is the first such role and text of the conversation) and cut_off."""
    firsts = rows.groupBy("conv_id", "role", "text").agg(F.min(F.struct("turn")).alias("first"))
    marked = rows.select("*", F.lit(0).alias("fresh")).unionByName(firsts.select(
        "conv_id", "first.turn", "role", "text", F.lit(0).cast("long").alias("copies"), F.lit(1).alias("fresh")))
    rows = marked.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"), F.max("fresh").alias("fresh"))
    blank = shown(F.col("text")) == ""
    return rows.select("conv_id", "turn", "role", "text", "copies", blank.alias("blank"),
                       F.when(blank, 0).otherwise(F.col("fresh")).alias("fresh"),
                       (~blank & ~F.substring(shown(F.col("text")), -1, 1).isin(".", "!", "?")).alias("cut_off"))


def repair(conversations: DataFrame) -> DataFrame:
    """Faults, price, edits and digest of the cheapest repair of every conversation of the table, which is damaged first."""
    rows = stored(with_faults(damaged(conversations)))
    n = parts(rows)
    part_schema, result_schema = arrow(PART), arrow(f"conv_id bigint, {RESULT}")
    order = ["conv_id", "turn", "role", "text"]
    dealt = rows.repartitionByRange(n, "conv_id", "turn", "role", F.substring("text", 1, 24)).sortWithinPartitions(*order)
    found = dealt.select("conv_id", "turn", F.substring("role", 1, 1), "blank", "fresh", "cut_off", "copies").mapInArrow(
        lambda batches: parse_parts(batches, part_schema), PART)
    named = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumn("part", F.lit(-1))
    results = (found.unionByName(named, allowMissingColumns=True).repartition(n, "conv_id").sortWithinPartitions("conv_id", "part")
               .mapInArrow(lambda batches: join_parts(batches, result_schema), f"conv_id bigint, {RESULT}"))
    names = [f.name for f in result_schema][1:]
    both = rows.select(*order, "copies").unionByName(results, allowMissingColumns=True).repartition(n, "conv_id")
    last = both.sortWithinPartitions("conv_id", F.col("audit").isNull(), *order[1:]).select(*order, "copies", *names)
    schema = f"conv_id bigint, {RESULT}, repaired_sha256 string"
    final = arrow(schema)
    return last.mapInArrow(lambda batches: digest(batches, final), schema)
