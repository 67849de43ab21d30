"""Conversation structure repair: A* on the edit lattice.

The rows of a conversation, in order, are edited so that the initials of the roles read
`(s?(ua)+)?`: Keep costs nothing, Rerole (to user or assistant) 1, Delete 2, Insert (an empty row
of user or assistant, anywhere) 5; a truncated row that stays adds 5; blank rows and duplicates
must go. A node of the lattice is (rows read, last role); the heuristic adds up what every row left
costs at least: 2 for one that must go, 2 for a truncated one (it goes or pays 5). The heap is keyed
(cost plus heuristic, audit), so of the cheapest edits the ASCII-least come first.

A conversation of more than CHUNK rows is searched a chunk at a time, from every role it can be
entered with to every role it can be left with, and the chunks' best (cost, audit) are put together;
two ways of equal cost between the same roles are never prefixes of each other, so the result is
that of one search. A task holds one code a row and the audit of a conversation, never its texts;
repaired rows are written as they stream past.

Faults, the first that holds counts: blank (nothing but white space), duplicate (role and text seen
earlier in the conversation), truncated (the last character that isn't white space is none of
`.!?`).

Defined results: null role and text are one space; an empty role has no initial and can't be kept;
rows go by turn, nulls first, then role, then text, so rows that repeat are duplicates; a null
conv_id is a conversation of its own; a conversation whose rows are all lost, and it alone, has no
rows after repair, zeros and an empty audit; texts of any length are read whole; columns other
than conv_id, turn, role and text are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._util import stored, table

# Fixed values of the contract.
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
WHITE = " \t\n\x0b\f\r"
LEGAL = ("su", "ua", "au")
KINDS, LOST, EMPTIED, UNENDED, REPEATED, AS_USER = 20, 0, 1, 2, 3, 4

CHUNK = 256
BATCH = 256
START, S, U, A = range(4)
_ROLE = {"s": S, "u": U, "a": A}
_KEPT = {(START, S): S, (START, U): U, (S, U): U, (U, A): A, (A, U): U}
_NEXT = {START: U, S: U, U: A, A: U}
_NAMES = {U: "user", A: "assistant"}
OK, MUST_GO, TRUNCATED = range(3)


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, lost: the rows after the contract's damage; lost rows stay as marks."""
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key) % KINDS
    text = F.coalesce("text", F.lit(" "))
    text = F.when(kind == EMPTIED, "").when(kind == UNENDED, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(kind == AS_USER, "user").otherwise(F.coalesce("role", F.lit(" ")))
    times = F.explode(F.array_repeat(F.lit(0), F.when(kind == REPEATED, 2).otherwise(1)))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind == LOST).alias("lost"), times.alias("_copy"))
    return rows.drop("_copy")


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, at (from 1), turn, role, text, fault of the rows that aren't lost."""
    rows = rows.where("not lost").select("conv_id", "turn", "role", "text")
    by_turn = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    again = Window.partitionBy("conv_id", "role", "text").orderBy("at")
    body = F.rtrim(F.col("text"), F.lit(WHITE))
    placed = rows.withColumn("at", F.row_number().over(by_turn)).withColumn("seen", F.row_number().over(again) > 1)
    fault = F.when(body == "", "blank").when(F.col("seen"), "duplicate").when(~F.right(body, F.lit(1)).isin(".", "!", "?"), "truncated")
    return placed.select("conv_id", "at", "turn", "role", "text", F.coalesce(fault, F.lit("")).alias("fault"))


def a_star(codes: bytes | bytearray, entry: int = START, whole: bool = True) -> dict[int, tuple[int, str]]:
    """Least (cost, audit) for the roles that rows can be left with, entered with role `entry`.

    A code is 4 * fault + role of the row (START: none that may be kept). whole: only the best of
    the ways that end a conversation.
    """
    n = len(codes)
    ahead = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        ahead[i] = ahead[i + 1] + (DELETE if codes[i] >= 4 * MUST_GO else 0)
    heap, closed, found = [(ahead[0], "", 0, entry)], set(), {}
    while heap:
        key, audit, i, role = heapq.heappop(heap)
        if (i, role) in closed:
            continue
        closed.add((i, role))
        cost = key - ahead[i]
        if i == n:
            if not whole:
                found[role] = (cost, audit)
            elif role in (START, A):
                return {role: (cost, audit)}
        ways = [(cost + INSERT, "I", i, _NEXT[role])]
        if i < n:
            fault, own = divmod(codes[i], 4)
            ways.append((cost + DELETE, "D", i + 1, role))
            if fault != MUST_GO:
                stays = cost + (CUT if fault == TRUNCATED else 0)
                ways.append((stays + REROLE, "R", i + 1, _NEXT[role]))
                if (role, own) in _KEPT:
                    ways.append((stays, "K", i + 1, own))
        for c, edit, j, to in ways:
            if (j, to) not in closed:
                heapq.heappush(heap, (c + ahead[j], audit + edit, j, to))
    return found


def _before(x: tuple, y: tuple) -> bool:
    """Whether way x, a (cost, chain of audits), comes before y; both chains are of one length."""
    if x[0] != y[0]:
        return x[0] < y[0]
    one, two, a, b = [], [], x[1], y[1]
    while a is not b:
        one.append(a[1])
        two.append(b[1])
        a, b = a[0], b[0]
    return "".join(reversed(one)) < "".join(reversed(two))


class Repair:
    """Takes the codes of a conversation one by one; finish() gives its least cost and audit."""

    def __init__(self, chunk: int = CHUNK) -> None:
        self.chunk, self.codes, self.best = chunk, bytearray(), {START: (0, None)}

    def add(self, code: int) -> None:
        self.codes.append(code)
        if len(self.codes) == self.chunk:
            self._close()

    def _close(self) -> None:
        best: dict[int, tuple] = {}
        for entry, (cost, chain) in self.best.items():
            for role, (more, audit) in a_star(self.codes, entry, whole=False).items():
                way = (cost + more, (chain, audit))
                if role not in best or _before(way, best[role]):
                    best[role] = way
        self.best, self.codes = best, bytearray()

    def finish(self) -> tuple[int, str]:
        if list(self.best.values()) == [(0, None)]:
            return next(iter(a_star(self.codes).values()))
        self._close()
        ends = [self.best[r] for r in (START, A) if r in self.best]
        cost, chain = ends[1] if len(ends) > 1 and _before(ends[1], ends[0]) else ends[0]
        parts = []
        while chain:
            chain, audit = chain
            parts.append(audit)
        return cost, "".join(reversed(parts))


class _Counts:
    def __init__(self, conv_id) -> None:
        self.conv_id, self.search, self.last = conv_id, Repair(), None
        self.first = self.turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, initial: str, fault: str) -> None:
        if turn is not None and turn != self.turn:
            self.first, self.turn, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        if self.last is not None:
            self.illegal += self.last + initial not in LEGAL
        self.last = initial
        code = MUST_GO if fault in ("blank", "duplicate") else TRUNCATED if fault == "truncated" else OK
        self.search.add(4 * code + _ROLE.get(initial, START))

    def row(self) -> tuple:
        gaps = self.turn - self.first + 1 - self.turns if self.turns else 0
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, *self.search.finish()


_COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def plans(rows: DataFrame, faulty: DataFrame) -> DataFrame:
    """One row for each conv_id of rows: its counts, cost and audit."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    marks = rows.select("conv_id").distinct().withColumn("at", F.lit(0))
    light = faulty.select("conv_id", "at", F.col("turn").cast("long").alias("turn"), F.left("role", F.lit(1)).alias("initial"), "fault")
    dealt = light.unionByName(marks, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "at")

    def search(batches):
        now = id_type = None
        for b in batches:
            id_type, done = b.column("conv_id").type, []
            for conv_id, at, turn, initial, fault in zip(*(b.column(c).to_pylist() for c in ("conv_id", "at", "turn", "initial", "fault"))):
                if at == 0:
                    if now:
                        done.append(now.row())
                    now = _Counts(conv_id)
                else:
                    now.add(turn, initial, fault)
            yield batch(done, id_type)
        if now:
            yield batch([now.row()], id_type)

    def batch(done, id_type):
        types = [id_type, *[pa.int64()] * 6, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate(types)], names=list(_COLUMNS))

    out = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    return stored(dealt.mapInArrow(search, out), "conversation-plans")


def repaired(planned: DataFrame, faulty: DataFrame) -> DataFrame:
    """conv_id, position (from 0), edit (K, R or I), role, text: the rows after repair."""
    kind = planned.schema["conv_id"].dataType.simpleString()
    heads = planned.select("conv_id", F.lit(0).alias("at"), "audit")
    dealt = faulty.select("conv_id", "at", "role", "text").unionByName(heads, allowMissingColumns=True)
    dealt = dealt.repartition("conv_id").sortWithinPartitions("conv_id", "at")
    names = ["conv_id", "position", "edit", "role", "text"]

    def edit(batches):
        conv_id = id_type = None
        audit, done, position, last, out = "", 0, 0, START, []

        def put(kind, role, text):
            nonlocal position, last
            last = _ROLE[role[0]] if kind == "K" else _NEXT[last]
            out.append((conv_id, position, kind, role if kind == "K" else _NAMES[last], text))
            position += 1

        def inserts():
            nonlocal done
            while audit[done : done + 1] == "I":
                put("I", "", "")
                done += 1

        for b in batches:
            id_type, out = b.column("conv_id").type, []
            for own, at, new, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "at", "audit", "role", "text"))):
                inserts()
                if at == 0:
                    conv_id, audit, done, position, last = own, new, 0, 0, START
                    continue
                if audit[done] != "D":
                    put(audit[done], role, text)
                done += 1
            yield batch(out, id_type)
        out = []
        inserts()
        if out:
            yield batch(out, id_type)

    def batch(out, id_type):
        types = [id_type, pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)

    fixed = dealt.mapInArrow(edit, f"conv_id {kind}, position long, edit string, role string, text string")
    return stored(fixed, "conversation-rows", batch=BATCH)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plans and repaired rows of (conv_id, turn, role, text), and lost, where damaged rows are marked."""
    lost = F.col("lost") if "lost" in rows.columns else F.lit(False)
    space = F.lit(" ")
    rows = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), lost.alias("lost"))
    faulty = stored(faults(rows), "conversation-faults")
    planned = plans(rows, faulty)
    return planned, repaired(planned, faulty)


def digests(fixed: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 over `role:text` lines of the repaired rows, in order."""
    kind = fixed.schema["conv_id"].dataType.simpleString()

    def take(batches):
        conv_id = state = id_type = None

        def batch(done):
            return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], id_type), pa.array([d[1] for d in done], pa.string())], names=["conv_id", "repaired_sha256"])

        for b in batches:
            id_type, done = b.column("conv_id").type, []
            for own, position, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "position", "role", "text"))):
                if position == 0:
                    if state:
                        done.append((conv_id, state.hexdigest()))
                    conv_id, state = own, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            yield batch(done)
        if state:
            yield batch([(conv_id, state.hexdigest())])

    lines = fixed.select("conv_id", "position", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "position")
    return lines.mapInArrow(take, f"conv_id {kind}, repaired_sha256 string")


def op12_a_star_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned, fixed = repair(damage(table(spark, sf_dir, "conversations")))
    hashed = digests(fixed).withColumnRenamed("conv_id", "_conv")
    empty = hashlib.sha256().hexdigest()
    joined = planned.join(hashed, planned["conv_id"].eqNullSafe(hashed["_conv"]), "left")
    return joined.select(*_COLUMNS, F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
