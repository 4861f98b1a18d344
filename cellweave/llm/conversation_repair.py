"""Repairs the structure of conversations by the cheapest edits.

The roles of a repaired conversation begin with ``(s?(ua)+)?``: a system turn at most, then user and assistant in turn.
Edits: Keep (cost 0), Rerole to user or assistant (2), Delete (3, required for blank and duplicate rows), Insert an empty
user or assistant turn anywhere (2); a truncated row that stays adds 1.

The conversation and the pattern's four states make a graph: nodes (rows consumed, state), an arc for each edit. The
least costs from the start and to the end tell which arcs are tight, that is on some cheapest path. A walk over tight
arcs keeps the frontier of states that the letters so far can lead to and takes the least letter that leaves it; it
never meets a dead end, and yields the ASCII-least of all cheapest audits.

Spark does the rest: equal rows collapse, first copies are found by sums, rows are sorted by ranges that may split a
conversation, and each range sends one byte a row. Only the audit, a letter an edit, is made in one place, and the texts
of a conversation pass through one task as a stream, because a digest of all of them has to.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm import common

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
SPACE = " \t\n\x0b\f\r"
#: A row's code is 4 * initial + fault.
S, U, A, OTHER = range(4)
SOUND, CUT, BLANK, DUPLICATE = range(4)
#: States of the pattern: nothing yet, after s, after u, after a. Where each initial leads from each, and what an inserted or reroled turn is.
STEP = {0: {S: 1, U: 2}, 1: {U: 2}, 2: {A: 3}, 3: {U: 2}}
TURN = {0: (U, 2), 1: (U, 2), 2: (A, 3), 3: (U, 2)}
ENDS = (0, 3)
ROLES = {U: "user", A: "assistant"}
_FAR = 1 << 30


def _arcs(code: int) -> list[list[tuple[str, int, int]]]:
    """For each state the edits that consume a row: (letter, cost, next state), letters in order."""
    initial, fault = code >> 2, code & 3
    out = []
    for q in range(4):
        arcs = [("D", DELETE, q)]
        if fault in (SOUND, CUT):
            more = TRUNCATED * (fault == CUT)
            if initial in STEP[q]:
                arcs.append(("K", KEEP + more, STEP[q][initial]))
            arcs.append(("R", REROLE + more, TURN[q][1]))
        out.append(arcs)
    return out


ARCS = [_arcs(code) for code in range(16)]


def _inserted_forward(f: list[int]) -> None:
    f[2] = min(f[2], min(f[0], f[1], f[3]) + INSERT)
    f[3] = min(f[3], f[2] + INSERT)


def _inserted_backward(b: list[int]) -> None:
    b[2] = min(b[2], b[3] + INSERT)
    b[0], b[1], b[3] = (min(b[q], b[2] + INSERT) for q in (0, 1, 3))


def cheapest(codes: bytes) -> tuple[int, str]:
    """(cost, audit) of a conversation's codes; 16 bytes of memory a row."""
    n = len(codes)
    back = array("i", [0]) * (4 * (n + 1))
    b = [0 if q in ENDS else _FAR for q in range(4)]
    _inserted_backward(b)
    back[4 * n :] = array("i", b)
    for i in range(n - 1, -1, -1):
        b = [min([cost + b[to] for _, cost, to in arcs]) for arcs in ARCS[codes[i]]]
        _inserted_backward(b)
        back[4 * i : 4 * i + 4] = array("i", b)
    total = b[0]
    f, frontier, i, audit = [0, _FAR, _FAR, _FAR], {0}, 0, []
    _inserted_forward(f)
    while True:
        if i == n and any(q in ENDS and f[q] == total for q in frontier):
            return total, "".join(audit)
        rest = back[4 * i : 4 * i + 4]
        tight = [("I", i, TURN[q][1]) for q in frontier if f[q] + INSERT + rest[TURN[q][1]] == total]
        if i < n:
            ahead = back[4 * i + 4 : 4 * i + 8]
            tight += [(letter, i + 1, to) for q in frontier for letter, cost, to in ARCS[codes[i]][q] if f[q] + cost + ahead[to] == total]
        letter = min(tight)[0]
        audit.append(letter)
        frontier = {to for x, _, to in tight if x == letter}
        if letter != "I":
            f = [min([f[q] + cost for q in range(4) for _, cost, to in ARCS[codes[i]][q] if to == state], default=_FAR) for state in range(4)]
            _inserted_forward(f)
            i += 1


@lru_cache(1 << 16)
def cheapest_of_few(codes: bytes) -> tuple[int, str]:
    return cheapest(codes)


def faults(codes: bytes) -> tuple[int, int, int, int]:
    """(blank, duplicate, truncated, illegal) of a conversation's codes; illegal: neighbours that are not su, ua or au."""
    c = np.frombuffer(codes, np.uint8)
    initial, fault = c >> 2, c & 3
    a, b = initial[:-1], initial[1:]
    legal = (a == S) & (b == U) | (a == U) & (b == A) | (a == A) & (b == U)
    return int((fault == BLANK).sum()), int((fault == DUPLICATE).sum()), int((fault == CUT).sum()), int((~legal).sum())


# --- rows --------------------------------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): what damage by crc32 of ``conv_id:turn`` modulo 20 leaves of each row, n times.

    0 drops the row (n is 0), 1 empties its text, 2 takes ``[.!?]`` out of it, 3 repeats it (n is 2), 4 makes its role
    user. Null ids and turns are a space in the hashed string, null roles and texts are a space.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    return conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("n"))


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("key", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)))


def _coded(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, key, n, code), a row for each set of equal rows; conversations without rows keep one of n 0."""
    last = F.substring(F.rtrim(F.col("text"), F.lit(SPACE)), -1, 1)
    fault = F.when(last == "", BLANK).when(last.isin(".", "!", "?"), SOUND).otherwise(CUT)
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", S).when(first == "u", U).when(first == "a", A).otherwise(OTHER)
    there = F.col("n") > 0
    lean = _keyed(rows).select("conv_id", *(F.when(there, F.col(c)).alias(c) for c in ("turn", "role", "key")), F.when(there, initial * 4 + fault).alias("code"), "n")
    same = lean.groupBy("conv_id", "turn", "role", "key", "code").agg(F.sum("n").alias("n"))
    same, _ = common.stored(same, "turns")
    begun = same.groupBy(F.col("conv_id").alias("c"), F.col("key").alias("k")).agg(F.min("turn").alias("least"), F.bool_or(F.col("turn").isNull()).alias("no_turn"))
    joined = same.join(begun, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("key").eqNullSafe(F.col("k")))
    again = F.when(F.col("no_turn"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("least"))
    return joined.select("conv_id", "turn", "role", "key", "n", "code", again.alias("again"))


SEGMENT_ROWS = 1 << 20


def _segments(coded: DataFrame) -> DataFrame:
    """(conv_id, part, seq, codes, first, last, turns): the rows of each conversation in order, cut where ranges end."""
    kind = coded.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "part", "seq", "codes", "first", "last", "turns"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        none = object()
        conv, seq, codes, first, last, turns, rows, kept = none, 0, bytearray(), None, None, 0, [], None

        def batch() -> pa.RecordBatch:
            types = [kept.field("conv_id").type, pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for b in batches:
            kept = b.schema
            for c, turn, n, code, again in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if c != conv or len(codes) >= SEGMENT_ROWS:
                    if conv is not none:
                        rows.append((conv, part, seq, bytes(codes), first, last, turns))
                    conv, seq, codes, first, last, turns = c, seq + 1, bytearray(), None, None, 0
                if not n:
                    continue
                if turn is not None:
                    turns += turn != last
                    first, last = turn if first is None else first, turn
                copy = code if code & 3 == BLANK else code | DUPLICATE
                codes.append(copy if again else code)
                codes.extend(bytes([copy]) * (n - 1))
            if len(rows) > 1000 or sum(len(r[3]) for r in rows[-16:]) > SEGMENT_ROWS:
                yield batch()
                rows = []
        if conv is not none:
            rows.append((conv, part, seq, bytes(codes), first, last, turns))
            yield batch()

    order = ("conv_id", "turn", "role", "key")
    ordered = coded.repartitionByRange(common.partitions(coded.sparkSession), *order).sortWithinPartitions(*order)
    return ordered.select("conv_id", "turn", "n", "code", "again").mapInArrow(run, f"conv_id {kind}, part int, seq int, codes binary, first long, last long, turns long")


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def audits(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation of ``rows`` (conv_id, turn, role, text, n).

    Rows count n times (n 0: the conversation is known, the row is gone). They stand by turn, nulls first; rows of one
    turn by role, then by a hash of their text, so that equal ones are neighbours. Roles and texts are not null. A role
    that begins with none of s, u and a, or is empty, can't be kept. A conversation without rows has zeros and an empty
    audit; null ids are one conversation; an empty table gives an empty result.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    grouped = _segments(_coded(rows)).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "seq", "codes", "first", "last", "turns"))).alias("segments"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for segments in b.column(1):
                own = segments.as_py()
                codes = b"".join(s["codes"] for s in own)
                own = [s for s in own if s["turns"]]
                turns = sum(s["turns"] for s in own) - sum(x["last"] == y["first"] for x, y in zip(own, own[1:], strict=False))
                cost, audit = (cheapest_of_few if len(codes) <= 64 else cheapest)(codes)
                out.append((own[-1]["last"] - own[0]["first"] + 1 - turns if own else 0, *faults(codes), cost, audit))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in out], pa.string() if k == 6 else pa.int64()) for k in range(7))], names=["conv_id", *(c.split()[0] for c in REPORT.split(", "))])

    return grouped.mapInArrow(run, f"conv_id {kind}, {REPORT}")


def edited(audit: str, rows: Iterator[tuple[str, str, int]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of each turn that stays or is inserted; rows: (role, text, n) in order."""
    state = 0
    each = ((role, text) for role, text, n in rows for _ in range(n))
    for letter in audit:
        if letter == "D":
            next(each)
        elif letter == "K":
            role, text = next(each)
            state = STEP[state]["sua".index(role[0])]
            yield letter, role, text
        else:
            text = next(each)[1] if letter == "R" else ""
            turn, state = TURN[state]
            yield letter, ROLES[turn], text


def _with_texts(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """Each conversation's report, then its rows in order; in one task, which reads them as a stream."""
    columns = [c.split() for c in REPORT.split(", ")]
    texts = _keyed(rows.where("n > 0")).select("conv_id", F.lit(1).alias("is_row"), "turn", "role", "key", "text", "n", *(F.lit(None).cast(t).alias(c) for c, t in columns))
    heads = reports.select("conv_id", F.lit(0).alias("is_row"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), *(F.lit(None).cast(t).alias(c) for c, t in (("role", "string"), ("key", "binary"), ("text", "string"), ("n", "long"))), *(c for c, _ in columns))
    both = heads.unionByName(texts).repartition(common.partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "is_row", "turn", "role", "key")
    return both.select("conv_id", "is_row", "role", "text", "n", *(c for c, _ in columns))


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, report, rows as a stream) of each conversation, in order; a stream not read to its end is read past."""
    every = (r for b in batches for at in range(0, b.num_rows, 256) for r in zip(*(c.to_pylist() for c in b.slice(at, 256).columns), strict=True))
    ahead = [next(every, None)]

    def rows() -> Iterator[tuple[str, str, int]]:
        ahead[0] = next(every, None)
        while ahead[0] is not None and ahead[0][1]:
            row = ahead[0]
            ahead[0] = next(every, None)
            yield row[2:5]

    while ahead[0] is not None:
        head = ahead[0]
        stream = rows()
        yield head[0], head[5:], stream
        for _ in stream:
            pass


def digests(rows: DataFrame) -> DataFrame:
    """``audits`` with repaired_sha256, the digest of the repaired ``role:text`` joined by newlines (none: of nothing)."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", *(c.split()[0] for c in REPORT.split(", ")), "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 6 + [pa.string()] * 2
        conv_type, out = None, []

        def noted() -> Iterator[pa.RecordBatch]:
            nonlocal conv_type
            for b in batches:
                conv_type = b.schema.field(0).type
                yield b

        for conv, report, stream in _conversations(noted()):
            digest, first = hashlib.sha256(), True
            for _, role, text in edited(report[-1], stream):
                digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
            out.append((conv, *report, digest.hexdigest()))
            if len(out) >= 1000 or len(report[-1]) > 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [conv_type, *types], strict=True)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [conv_type, *types], strict=True)], names=names)

    reports, _ = common.stored(audits(rows), "audits")
    return _with_texts(rows, reports).mapInArrow(run, f"conv_id {kind}, {REPORT}, repaired_sha256 string")


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, edit): the turns of every repaired conversation, numbered from 0; see ``audits``."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "turn", "role", "text", "edit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_type, out, held = None, [], 0

        def noted() -> Iterator[pa.RecordBatch]:
            nonlocal conv_type
            for b in batches:
                conv_type = b.schema.field(0).type
                yield b

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [conv_type, pa.int64(), *[pa.string()] * 3], strict=True)], names=names)

        for conv, report, stream in _conversations(noted()):
            for turn, (letter, role, text) in enumerate(edited(report[-1], stream)):
                out.append((conv, turn, role, text, letter))
                held += len(text)
                if len(out) >= 1000 or held > 1 << 22:
                    yield batch()
                    out, held = [], 0
        if out:
            yield batch()

    reports, _ = common.stored(audits(rows), "audits")
    return _with_texts(rows, reports).mapInArrow(run, f"conv_id {kind}, turn long, role string, text string, edit string")
