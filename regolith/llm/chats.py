"""Conversations that were damaged, and their cheapest repair.

The repair is a composition of three weighted machines: the acceptor of a conversation's rows in order, a transducer that
keeps, reroles or deletes a row or inserts one, and the acceptor of the role grammar. Their composed states (rows read, state of
the grammar) are made as they are reached; weights are (cost, string of edits), compared in this order. Insertions stand
before the row that they precede, two at most, since a third returns to a state that costs less; so the composed machine has
no cycle. Two strings of edits over the same rows then are never one the other's beginning, so that the least string of a
part stays the least in whole, and parts of a conversation can be composed apart: each as a matrix of weights from
state to state. That is how long conversations are split over tasks.

Rows are ordered by Spark: (conversation, turn, role, text) in ranges, so the rows of one conversation may lie in several tasks.
A first pass gives each part's matrix, counts and ends, a second one puts together the parts of each conversation, and a
third streams the repaired rows through one hash a conversation, a batch at a time.

Defined results: null ids, turns, roles and texts are one space where they are written or compared as text; null turns come
first. Turns that are no integers count as null. Rows of equal turn come in order of role, then text. Identical rows are one row with a count; all but the first are
duplicates. A null conversation id is a conversation of its own. Columns beside those named are dropped. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
#: Costs of the edits, and of a truncated row that stays.
COSTS = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
TRUNCATED = 3
USER, ASSISTANT = "user", "assistant"
#: The role grammar (s?(ua)+)? by role initials: state -> {initial: state}; states where it may end.
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
FINAL = (0, 3)
_ROLES = {"u": USER, "a": ASSISTANT}
#: Rows of a part at most.
PART = 4096
OK, BLANK, DUPLICATE, CUT = 0, 1, 2, 3

Weight = tuple[int, str]
Matrix = dict[int, dict[int, Weight]]


def _better(at: dict[int, Weight], state: int, weight: Weight) -> None:
    if state not in at or weight < at[state]:
        at[state] = weight


def insertions(state: int) -> dict[int, Weight]:
    """The states that insertions reach, with their weights."""
    out, edge, label = {state: (0, "")}, [state], ""
    for n in (1, 2):
        label += INSERT
        edge = [GRAMMAR[s][x] for s in edge for x in _ROLES if x in GRAMMAR[s]]
        for s in edge:
            _better(out, s, (n * COSTS[INSERT], label))
    return out


_INSERTED = {s: insertions(s) for s in GRAMMAR}


def edits(state: int, initial: str, fault: int) -> Iterator[tuple[int, int, str]]:
    """(next state, cost, edit) of one row, without insertions."""
    yield state, COSTS[DELETE], DELETE
    if fault in (BLANK, DUPLICATE):
        return
    more = TRUNCATED if fault == CUT else 0
    moves = GRAMMAR[state]
    if initial in moves:
        yield moves[initial], COSTS[KEEP] + more, KEEP
    for x in _ROLES:
        if x in moves:
            yield moves[x], COSTS[REROLE] + more, REROLE


def row_matrix(initial: str, fault: int) -> Matrix:
    out: Matrix = {}
    for start in GRAMMAR:
        at: dict[int, Weight] = {}
        for state, (c, label) in _INSERTED[start].items():
            for to, cost, edit in edits(state, initial, fault):
                _better(at, to, (c + cost, label + edit))
        out[start] = at
    return out


def after(at: dict[int, Weight], matrix: Matrix) -> dict[int, Weight]:
    """Weights by state, one part on."""
    out: dict[int, Weight] = {}
    for state, (cost, label) in at.items():
        for to, (c, more) in matrix[state].items():
            _better(out, to, (cost + c, label + more))
    return out


def composed(a: Matrix, b: Matrix) -> Matrix:
    return {s: after(at, b) for s, at in a.items()}


IDENTITY: Matrix = {s: {s: (0, "")} for s in GRAMMAR}
_KNOWN: dict[tuple[str, int], Matrix] = {}


def matrix_of(initial: str, fault: int) -> Matrix:
    key = (initial if initial in "sua" else "", fault)
    if key not in _KNOWN:
        _KNOWN[key] = row_matrix(*key)
    return _KNOWN[key]


def repeated(matrix: Matrix, times: int) -> Matrix:
    out = IDENTITY
    while times:
        out = composed(out, matrix) if times & 1 else out
        times >>= 1
        matrix = composed(matrix, matrix) if times else matrix
    return out


def ended(at: dict[int, Weight]) -> Weight:
    """The least weight that ends the grammar, insertions at the end included."""
    out: dict[int, Weight] = {}
    for state, (cost, label) in at.items():
        for to, (c, more) in _INSERTED[state].items():
            if to in FINAL:
                _better(out, 0, (cost + c, label + more))
    return out[0]


# The damage, as columns.


def key_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, times): rows after the damage that their key's hash says, identical ones counted."""
    how = F.crc32(F.concat(key_text(F.col(conv)), F.lit(":"), key_text(F.col(turn)))) % 20
    said = key_text(F.col(text))
    return counted(
        rows.select(F.col(conv).alias("conv"), F.col(turn).try_cast("long").alias("turn"), key_text(F.col(role)).alias("_role"), said.alias("_text"), how.alias("_how"))
        .filter("_how <> 0")
        .select("conv", "turn", F.when(F.col("_how") == 4, USER).otherwise(F.col("_role")).alias("role"), F.when(F.col("_how") == 1, "").when(F.col("_how") == 2, F.regexp_replace("_text", "[.!?]", "")).otherwise(F.col("_text")).alias("text"), F.when(F.col("_how") == 3, 2).otherwise(1).alias("n")),
        "n",
    )


def counted(rows: DataFrame, times: str | None = None) -> DataFrame:
    return rows.groupBy("conv", "turn", "role", "text").agg((F.sum(times) if times else F.count(F.lit(1))).cast("long").alias("times"))


def faults(rows: DataFrame) -> DataFrame:
    """The counted rows with the first row's fault: blank, said before in the conversation, truncated, or none.

    What a conversation says at several turns is few rows, found by a partial aggregation.
    """
    spaced = r"[^\x20\x09-\x0D]"
    bare = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    again = rows.groupBy("conv", "role", "text").agg(F.count(F.lit(1)).alias("_n"), F.min("turn").alias("_least"), F.bool_or(F.col("turn").isNull()).alias("_null")).filter("_n > 1")
    again = again.select(F.col("conv").alias("_conv"), F.col("role").alias("_role"), F.col("text").alias("_text"), "_least", "_null")
    met = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("text") == F.col("_text"))
    later = F.coalesce(F.col("turn").isNotNull() & (F.col("_null") | (F.col("turn") > F.col("_least"))), F.lit(False))
    last = F.substring(bare, -1, 1)
    fault = F.when(~F.col("text").rlike(spaced), BLANK).when(later, DUPLICATE).when(~last.isin(".", "!", "?"), CUT).otherwise(OK)
    return rows.join(again, met, "left").select("conv", "turn", "role", "text", "times", fault.cast("int").alias("fault"))


# Parts of conversations, in order.

_MATRIX = pa.list_(pa.struct([("a", pa.int8()), ("b", pa.int8()), ("cost", pa.int64()), ("label", pa.string())]))
_PART = [("part", pa.int32()), ("piece", pa.int64()), ("matrix", _MATRIX), ("turns", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("ends", pa.list_(pa.string()))]
_PART_TYPE = "part int, piece long, matrix array<struct<a:tinyint,b:tinyint,cost:long,label:string>>, turns array<long>, counts array<long>, ends array<string>"
_NEXT = {"su", "ua", "au"}


class _Part:
    """Consecutive rows of one conversation."""

    def __init__(self):
        self.rows, self.matrix, self.least, self.most, self.distinct = 0, IDENTITY, None, None, 0
        self.blank = self.duplicate = self.cut = self.illegal = 0
        self.first = self.last = None

    def add(self, turn, role, times, fault):
        initial = role[:1]
        if turn is not None:
            self.distinct += turn != self.most
            self.least, self.most = turn if self.least is None else self.least, turn
        self.illegal += (self.last is not None and self.last + initial not in _NEXT) + (times - 1)  # no role may follow itself
        self.first, self.last = initial if self.first is None else self.first, initial
        self.blank += times if fault == BLANK else 0
        self.duplicate += 0 if fault == BLANK else times if fault == DUPLICATE else times - 1
        self.cut += fault == CUT
        self.matrix = composed(self.matrix, matrix_of(initial, fault))
        if times > 1:
            self.matrix = composed(self.matrix, repeated(matrix_of(initial, BLANK if fault == BLANK else DUPLICATE), times - 1))
        self.rows += 1

    def values(self, piece):
        cells = [{"a": a, "b": b, "cost": c, "label": s} for a, at in self.matrix.items() for b, (c, s) in at.items()]
        return piece, cells, None if self.least is None else [self.least, self.most, self.distinct], [self.blank, self.duplicate, self.cut, self.illegal], [self.first, self.last]


def _parts(most: int):
    def run(batches):
        number, held, conv, piece = TaskContext.get().partitionId(), None, None, 0
        for batch in batches:
            convs, turns, roles, times, marks = (batch.column(i) for i in range(5))
            names, out = convs.to_pylist(), []
            for i, (c, t, r, n, f) in enumerate(zip(names, turns.to_pylist(), roles.to_pylist(), times.to_pylist(), marks.to_pylist())):
                if held is None or c != conv or held.rows >= most:
                    if held is not None:
                        out.append((conv, *held.values(piece)))
                    held, conv, piece = _Part(), c, piece + 1
                held.add(t, r, n, f)
            yield _told(out, convs.type, number)
        if held is not None:
            yield _told([(conv, *held.values(piece))], convs.type, number)
        release()

    return run


def _told(rows, kind, number):
    columns = list(zip(*rows)) if rows else [[]] * 6
    arrays = [pa.array(columns[0], kind), pa.array([number] * len(rows), pa.int32())]
    return pa.RecordBatch.from_arrays([*arrays, *(pa.array(c, t) for c, (_, t) in zip(columns[1:], _PART[1:]))], ["conv", *(n for n, _ in _PART)])


class _Whole:
    """The parts of one conversation put together, as they come."""

    def __init__(self):
        self.at, self.least, self.most, self.distinct, self.counts, self.last = {0: (0, "")}, None, None, 0, [0, 0, 0, 0], None

    def add(self, matrix, turns, counts, ends):
        m: Matrix = {s: {} for s in GRAMMAR}
        for x in matrix:
            m[x["a"]][x["b"]] = (x["cost"], x["label"])
        self.at = after(self.at, m)
        if turns is not None:
            self.distinct += turns[2] - (turns[0] == self.most)
            self.least, self.most = turns[0] if self.least is None else self.least, turns[1]
        self.counts = [a + b for a, b in zip(self.counts, counts)]
        if self.last is not None and self.last + ends[0] not in _NEXT:
            self.counts[3] += 1
        self.last = ends[1]

    def values(self):
        cost, audit = ended(self.at)
        gaps = 0 if self.least is None else min(self.most - self.least + 1 - self.distinct, 2**63 - 1)
        return gaps, *self.counts, cost, audit


_SUMS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _wholes(batches):
    held, conv, kind = None, None, pa.null()
    columns = lambda rows: [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, [kind, *[pa.int64()] * 6, pa.string()])]
    for batch in batches:
        kind, out = batch.column(0).type, []
        for c, *x in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if held is None or c != conv:
                if held is not None:
                    out.append((conv, *held.values()))
                held, conv = _Whole(), c
            held.add(*x)
        yield pa.RecordBatch.from_arrays(columns(out), ["conv", *_SUMS, "audit"])
    if held is not None:
        yield pa.RecordBatch.from_arrays(columns([(conv, *held.values())]), ["conv", *_SUMS, "audit"])


def repaired_rows(audit: str, rows: Iterator[tuple[str, str, int]]) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired rows, from the edits and the counted rows (role, text, times) in order."""
    state, at = 0, 0

    def inserted():
        nonlocal state, at
        while at < len(audit) and audit[at] == INSERT:
            x = next(x for x in _ROLES if x in GRAMMAR[state])
            state, at = GRAMMAR[state][x], at + 1
            yield _ROLES[x], ""

    for role, text, times in rows:
        for _ in range(times):
            yield from inserted()
            edit, at = audit[at], at + 1
            if edit == KEEP:
                state = GRAMMAR[state][role[:1]]
                yield role, text
            elif edit == REROLE:
                x = next(x for x in _ROLES if x in GRAMMAR[state])
                state = GRAMMAR[state][x]
                yield _ROLES[x], text
    yield from inserted()


def _hashes(batches):
    """From rows in order, each conversation's edits before its rows, to one hash a conversation."""
    kind = [pa.null()]

    def rows():
        for batch in batches:
            kind[0] = batch.column(0).type
            yield from zip(*(batch.column(i).to_pylist() for i in range(5)))

    out = []

    def done():
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], kind[0]), pa.array([h for _, h in out], pa.string())], ["conv", "repaired_sha256"])

    for conv, group in groupby(rows(), key=lambda r: r[0]):
        audit = next(group)[1]
        digest, first = hashlib.sha256(), True
        for role, text in repaired_rows(audit, ((r, t, n) for _, _, r, t, n in group)):
            digest.update((b"" if first else b"\n") + f"{role}:{text}".encode("utf-8", "surrogatepass"))
            first = False
        out.append((conv, digest.hexdigest()))
        if len(out) >= 10_000:
            yield done()
            out.clear()
    if out:
        yield done()
    release()


def repair(rows: DataFrame, part: int = PART) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) and `repaired_sha256`, for rows as `counted` has them."""
    kind = rows.schema["conv"].dataType.simpleString()
    order = ["conv", "turn", "role", "text"]
    marked = materialize(faults(rows), "chat-rows")
    ranged = marked.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn", "role", "times", "fault")
    parts = materialize(ranged.mapInArrow(_parts(part), f"conv {kind}, {_PART_TYPE}"), "chat-parts")
    sums = ", ".join(f"{n} long" for n in _SUMS)
    joined = parts.repartition("conv").sortWithinPartitions("conv", "part", "piece").select("conv", "matrix", "turns", "counts", "ends")
    whole = materialize(joined.mapInArrow(_wholes, f"conv {kind}, {sums}, audit string"), "chat-wholes")
    none = F.lit(None)
    heads = whole.select("conv", "audit", none.cast("string").alias("role"), none.cast("string").alias("text"), none.cast("long").alias("times"), none.cast("long").alias("turn"), F.lit(0).alias("step"))
    lines = marked.select("conv", none.cast("string").alias("audit"), "role", "text", "times", "turn", F.lit(1).alias("step"))
    stream = heads.unionByName(lines).repartition("conv").sortWithinPartitions("conv", "step", "turn", "role", "text").select("conv", "audit", "role", "text", "times")
    hashed = stream.mapInArrow(_hashes, f"conv {kind}, repaired_sha256 string").withColumnRenamed("conv", "_conv")
    return whole.join(hashed, F.col("conv").eqNullSafe(F.col("_conv"))).drop("_conv")


def report(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation of the table: its damage and repair, zeros and the hash of nothing where no row is left."""
    found = repair(damaged(rows, conv, turn, role, text))
    every = rows.select(F.col(conv).alias("_id")).distinct()
    out = every.join(found, F.col("_id").eqNullSafe(F.col("conv")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _SUMS]
    return out.select(F.col("_id").alias(conv), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
