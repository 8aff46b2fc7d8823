"""Conversation structure repair by weighted interval parsing.

What a repaired conversation may be is a grammar over edited rows in Chomsky normal form. Its nonterminals (p, q) stand for edits of a span of rows that lead from state p to
state q of `(s?(ua)+)?`; a rule (p, q) -> (p, r)(r, q) joins two neighbouring spans, terminals are the edits of one row, and the closure of insertions is part of both ends of
a row. A cell of the chart keeps for each nonterminal the least (cost, audit). Spans are joined bottom-up by their length. All ways to split a span give the same cell, as joining is associative
and no audit of a cell begins another of its cost (they would differ by insertions, which cost); so one split for each span is enough, into halves of 1, 2, 4, ... rows.

Rows are sorted over all tasks, so a long conversation lies in many: each parses its spans of up to 512 rows, a chart over the spans of a conversation picks the states
between them, and each span is then rendered where it lies. What a conversation needs in one place are its audit and a running hash, which reads its pieces in order.

Rules for rows: null ids and turns are values of their own (first in order), null roles and texts are one space. Rows of one turn come by role, then text, so that equal rows
are neighbours. Empty and very long texts, repeated rows and empty tables are as any others. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import BLANK, materialize

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
#: States of `(s?(ua)+)?`: at the start, after s, after u, after a. Ways by a role's initial.
WAYS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, START, ENDS = range(4), 0, (0, 3)
ROLES = {"u": "user", "a": "assistant"}
#: Least (cost, audit) by (state before, state after).
Cell = dict[tuple[int, int], tuple[int, str]]
SPAN_ROWS, SPAN_BYTES = 512, 4 << 20
LEGAL = ("su", "ua", "au")
FAULTS = ("blank", "duplicate", "truncated")

DROP, EMPTY, UNSTOP, REPEAT, AS_USER, KINDS = 0, 1, 2, 3, 4, 20


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults by crc32 of `conv_id:turn`: dropped, emptied, without stops, repeated, or said by the user."""
    spelled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spelled("conv_id"), F.lit(":"), spelled("turn")).cast("binary")) % KINDS
    text = F.when(kind == EMPTY, F.lit("")).when(kind == UNSTOP, F.regexp_replace(spelled("text"), "[.!?]", "")).otherwise(spelled("text"))
    copies = F.when(kind == REPEAT, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    kept = rows.filter(kind != DROP)
    return kept.select("conv_id", "turn", F.when(kind == AS_USER, F.lit("user")).otherwise(spelled("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def with_faults(rows: DataFrame) -> DataFrame:
    """Distinct rows with their number n, and whether the first of them is blank, a duplicate or truncated (its first fault, else null); the others repeat it, so are blank or duplicates."""
    again = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    first = again.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("text").alias("t")).agg(F.min(_order("turn")).alias("first"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("text") == F.col("t"))
    # the last character that isn't blank; a text has one unless it is blank
    last = F.regexp_extract("text", rf"([^{BLANK}])[{BLANK}]*\z", 1)
    fault = F.when(last == "", "blank").when(_order("turn") > F.col("first"), "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    return again.join(first, same).select("conv_id", "turn", "role", "text", "n", fault.alias("fault"))


def _order(c: str) -> Column:
    return F.struct(F.col(c).isNotNull().alias("given"), F.col(c).alias("at"))


# the grammar


def joined(a: Cell, b: Cell) -> Cell:
    """(p, q) -> (p, r)(r, q)"""
    out: Cell = {}
    for (p, r), (x, left) in a.items():
        for q in STATES:
            if (r, q) in b:
                y, right = b[r, q]
                if (p, q) not in out or (x + y, left + right) < out[p, q]:
                    out[p, q] = x + y, left + right
    return out


def least(cells: Iterable[Cell]) -> Cell:
    out: Cell = {}
    for cell in cells:
        for way, got in cell.items():
            if way not in out or got < out[way]:
                out[way] = got
    return out


#: Insertions between rows: none, or as many as lead on; all states are reached within as many steps as there are.
NOTHING: Cell = {(p, p): (0, "") for p in STATES}
INSERTED: Cell = {(p, q): (INSERT_COST, INSERT) for (p, initial), q in WAYS.items() if initial in ROLES}
CLOSURE = NOTHING
for _ in STATES:
    CLOSURE = least([CLOSURE, joined(CLOSURE, INSERTED)])


def row_cell(initial: str, fault: str | None) -> Cell:
    """Edits of a row with its insertions before and after."""
    deleted: Cell = {(p, p): (DELETE_COST, DELETE) for p in STATES}
    if fault in FAULTS[:2]:
        edits = deleted
    else:
        more = TRUNCATED_COST if fault == "truncated" else 0
        reroled: Cell = {(p, q): (REROLE_COST + more, REROLE) for (p, other), q in WAYS.items() if other in ROLES}
        kept: Cell = {(p, q): (more, KEEP) for (p, own), q in WAYS.items() if own == initial}
        edits = least([deleted, reroled, kept])
    return joined(joined(CLOSURE, edits), CLOSURE)


ROW_CELLS = {(i, f): row_cell(i, f) for i in ("s", "u", "a", "") for f in (None, *FAULTS)}


def cell_of(initial: str, fault: str | None) -> Cell:
    return ROW_CELLS[initial if initial in ("s", "u", "a") else "", fault]


def parse(cells: list[Cell]) -> Cell:
    """The cell of the whole span, from those of neighbours: joined in pairs, then pairs of these, and so on."""
    while len(cells) > 1:
        cells = [joined(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0] if cells else CLOSURE


def best(cell: Cell) -> tuple[int, str, int]:
    """Least cost and audit of a conversation, and the state that it ends in."""
    return min((*cell[START, q], q) for q in ENDS if (START, q) in cell)


def split(cells: list[Cell]) -> list[tuple[int, str]]:
    """For each of a conversation's spans the state that it begins in and its part of the best audit."""
    charts = [cells]
    while len(charts[-1]) > 1:
        below = charts[-1]
        charts.append([joined(*below[i : i + 2]) if i + 1 < len(below) else below[i] for i in range(0, len(below), 2)])
    chosen = [(START, best(charts[-1][0])[2])] if cells else []
    for below in charts[-2::-1]:
        halves = []
        for i, (p, q) in enumerate(chosen):
            if 2 * i + 1 < len(below):
                a, b = below[2 * i], below[2 * i + 1]
                *_, r = min((a[p, r][0] + b[r, q][0], a[p, r][1] + b[r, q][1], r) for r in STATES if (p, r) in a and (r, q) in b)
                halves += [(p, r), (r, q)]
            else:
                halves.append((p, q))
        chosen = halves
    return [(p, cell[p, q][1]) for cell, (p, q) in zip(cells, chosen)]


def render(audit: str, state: int, rows: Iterable[tuple[str, str]]) -> Iterator[str]:
    """`role:text` of what the edits leave of the rows, from a state on."""
    rows = iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == INSERT else next(rows)
        if edit == DELETE:
            continue
        if edit != KEEP:  # only one of the two roles leads on
            role = next(name for initial, name in ROLES.items() if (state, initial) in WAYS)
        yield f"{role}:{text}"
        state = WAYS[state, role[:1]]


# spans over tasks

SPANS = (
    "conv_id {kind}, part int, nth int, n long, blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string, "
    "cell string, roles array<string>, texts array<string>, repeats array<long>"
)


def _pack(cell: Cell) -> str:
    return ";".join(f"{p},{q},{cost},{audit}" for (p, q), (cost, audit) in cell.items())


def _unpack(packed: str) -> Cell:
    return {(int(p), int(q)): (int(cost), audit) for p, q, cost, audit in (x.split(",") for x in packed.split(";"))}


def _spans(rows: DataFrame) -> DataFrame:
    """Sorted rows as spans: counts of faults, the cell, and the rows themselves."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    dealt = rows.repartitionByRange(*(F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")))
    dealt = dealt.sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text"))).withColumn("part", F.spark_partition_id())

    def run(batches: Iterable[pa.RecordBatch]):
        nth = 0
        for (conv, part), rows in groupby(_rows(batches), key=lambda r: r[:2]):
            for span in _cut(rows):
                yield _span(conv, part, nth, span, arrow)
                nth += 1

    arrow = to_arrow_type(dealt.schema["conv_id"].dataType)
    return dealt.select("conv_id", "part", "role", "text", "n", "fault").mapInArrow(run, SPANS.format(kind=kind))


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _cut(rows: Iterable[tuple]) -> Iterator[list[tuple]]:
    """Spans of bounded rows and bytes. A row that repeats is cut too: what follows are duplicates."""
    held, size, count = [], 0, 0
    for _, _, role, text, n, fault in rows:
        first = True
        while n:
            some = min(n, SPAN_ROWS - count)
            held.append((role, text, some, fault, first))
            n, first = n - some, False
            size, count = size + len(text), count + some
            if count >= SPAN_ROWS or size >= SPAN_BYTES:
                yield held
                held, size, count = [], 0, 0
    if held:
        yield held


def _span(conv, part: int, nth: int, span: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    cells, faults, initials = [], dict.fromkeys(FAULTS, 0), []
    for role, _, n, fault, first in span:
        again = fault if fault == "blank" else "duplicate"
        for i in range(n):
            own = fault if first and not i else again
            cells.append(cell_of(role[:1], own))
            if own:
                faults[own] += 1
            initials.append(role[:1])
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
    values = [[conv], [part], [nth], [len(cells)], *([faults[f]] for f in FAULTS), [illegal], [initials[0]], [initials[-1]], [_pack(parse(cells))]]
    values += [[[r[k] for r in span]] for k in range(3)]
    kinds = [kind, pa.int32(), pa.int32(), *[pa.int64()] * 5, *[pa.string()] * 3, pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=[x.split()[0] for x in SPANS.split(", ")])


def repaired(rows: DataFrame) -> DataFrame:
    """For each conversation that has rows: conv_id, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    spans = materialize(_spans(with_faults(rows)), "spans")
    kind = spans.schema["conv_id"].dataType.simpleString()
    arrow = to_arrow_type(spans.schema["conv_id"].dataType)
    # a conversation's spans without their rows
    shown = spans.select("conv_id", "part", "nth", *FAULTS, "illegal", "first_initial", "last_initial", "cell")

    def choose(batches: Iterable[pa.RecordBatch]):
        for conv, got in groupby(_rows(batches), key=lambda r: r[0]):
            got = list(got)
            cells = [_unpack(r[9]) for r in got]
            cost, audit, _ = best(parse(cells))
            seams = sum(a[8] + b[7] not in LEGAL for a, b in zip(got, got[1:]))
            totals = [sum(r[3 + k] for r in got) for k in range(4)]
            totals[3] += seams
            for i, (r, (state, own)) in enumerate(zip(got, split(cells))):
                yield _row(
                    [conv, r[1], r[2], state, own, *(totals if not i else [None] * 4), cost if not i else None, audit if not i else None],
                    [arrow, pa.int32(), pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 5, pa.string()],
                    ["conv_id", "part", "nth", "state", "own", *FAULTS, "illegal", "cost", "audit"],
                )

    by_conversation = lambda df: df.repartition("conv_id").sortWithinPartitions("conv_id", "part", "nth")
    shape = f"conv_id {kind}, part int, nth int, state int, own string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    chosen = by_conversation(shown).mapInArrow(choose, shape)
    placed = chosen.join(spans.select("part", "nth", "roles", "texts", "repeats"), ["part", "nth"])

    def hashed(batches: Iterable[pa.RecordBatch]):
        for conv, got in groupby(_rows(batches), key=lambda r: r[0]):
            digest, some, head = hashlib.sha256(), False, None
            for r in got:
                head = head or r[5:11]
                said = ((role, text) for role, text, n in zip(*r[11:14]) for _ in range(n))
                for piece in render(r[4], r[3], said):
                    digest.update(("\n" if some else "").encode() + piece.encode())
                    some = True
            yield _row([conv, *head, digest.hexdigest()], [arrow, *[pa.int64()] * 5, pa.string(), pa.string()], ["conv_id", *FAULTS, "illegal", "cost", "audit", "repaired_sha256"])

    return by_conversation(placed.select("conv_id", "part", "nth", "state", "own", *FAULTS, "illegal", "cost", "audit", "roles", "texts", "repeats")).mapInArrow(
        hashed, f"conv_id {kind}, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    )


def _row(values: list, kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)


def repair(conversations: DataFrame) -> DataFrame:
    """All conversations after damage: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. gaps counts turns that lack between the least and the greatest."""
    after = damaged(conversations.select("conv_id", "turn", "role", "text"))
    every = conversations.groupBy("conv_id").agg(F.lit(0).alias("none")).select(F.col("conv_id").alias("of"))
    turns = after.groupBy("conv_id", "turn").agg(F.lit(0).alias("none")).groupBy(F.col("conv_id").alias("c"))
    turns = turns.agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    done = repaired(after)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    same = lambda c: F.col("of").eqNullSafe(F.col(c))
    return (
        every.join(turns, same("c"), "left")
        .join(done, same("conv_id"), "left")
        .select(
            F.col("of").alias("conv_id"),
            *(zero(c) for c in ("gaps", *FAULTS, "illegal", "cost")),
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
        )
    )
