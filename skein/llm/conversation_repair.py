"""Repair of role sequences in conversations by a scan of min-plus matrices.

A repaired conversation has role initials ``(s?(ua)+)?``, read by four states: nothing yet, after the system
turn, after a user turn, after an assistant turn. Every turn is a 4x4 matrix whose entries are the cheapest
(cost, audit) from one state to another, with the closure of insertions on its right. Products of such matrices are
associative: costs add, audits are joined, and of several ways the cheapest counts, then the least audit. Joining
keeps that order, since two ways of one cost through the same turns are never each other's beginning.

Rows are dealt by ranges of (conversation, turn, role, beginning of text), so a conversation of any length is
spread over as many tasks as its rows need. A task finishes every conversation that it holds whole. Those at the edges
of its range, and those beyond ``WHOLE_BYTES``, are *open*: their rows go to a table, duplicates are told across
blocks, each block becomes one matrix, and ``FAN`` neighbouring blocks are multiplied a round until one is left.
The audit then goes back to the rows in order. Only that last step has all rows of an open conversation pass
through one task, one after another and without holding them, because a SHA-256 cannot be put together from parts; the
audit, one value of the result, and the matrix that it comes from grow with the conversation.

Defined results: nulls in ``role`` and ``text`` are one space; rows without ``conv_id`` are one conversation; rows
without ``turn`` come first; rows of one turn are ordered by role, then text; fully equal rows are duplicates of the
first; a role without an initial is none of the three; ``gaps`` beyond 64 bits are null; an empty table gives an empty
result; further columns are ignored. Texts are compared by 128-bit hashes across blocks, by themselves within one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.storage import Scope

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SPACES = " \t\n\v\f\r"
ENDS = ".!?"
#: A conversation with more text than this in one task is not held whole.
WHOLE_BYTES = 16 << 20
#: Blocks that are multiplied in one step, and rows of an output batch.
FAN, BATCH = 16, 2000

Element = tuple[int, str] | None
Matrix = list[Element]  # 16 entries, row by row

COUNTS = ("blank", "duplicate", "truncated", "illegal")
RESULT = ["gaps", *COUNTS, "cost", "audit", "repaired_sha256"]
_RESULT_TYPES = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
SCANNED = f"kind int, conv_id long, part int, n long, turn long, role string, text string, copies int, print binary, first boolean, fault string, {_RESULT_TYPES}"
FACTS = "conv_id long, block long, blank long, duplicate long, truncated long, illegal long, low long, high long, turns long, first_turn long, last_turn long, first_role string, last_role string, costs array<long>, audits array<string>"
WALKED = f"conv_id long, {_RESULT_TYPES}"
TURNS = "conv_id long, place long, role string, text string"
CONVERSATION, OPEN_ROW, TURN = 0, 1, 2


def times(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = [None] * 16
    for i in range(0, 16, 4):
        for k in range(4):
            x = a[i + k]
            if x is None:
                continue
            for j in range(4):
                y = b[4 * k + j]
                if y is None:
                    continue
                cost, now = x[0] + y[0], out[i + j]
                if now is None or cost < now[0]:
                    out[i + j] = (cost, x[1] + y[1])
                elif cost == now[0] and (audit := x[1] + y[1]) < now[1]:
                    out[i + j] = (cost, audit)
    return out


def plus(a: Matrix, b: Matrix) -> Matrix:
    return [min((x for x in pair if x is not None), default=None) for pair in zip(a, b, strict=True)]


def _steps(initial: str, element: Element) -> Matrix:
    """A turn with this initial: state after for each state before."""
    moves = {"s": [(0, 1)], "u": [(0, 2), (1, 2), (3, 2)], "a": [(2, 3)]}.get(initial, [])
    return [element if (i, j) in moves else None for i in range(4) for j in range(4)]


def _always(element: Element) -> Matrix:
    return [element if i == j else None for i in range(4) for j in range(4)]


@lru_cache(maxsize=1)
def closure() -> Matrix:
    """Any number of insertions: with the nearest two every state that they reach is reached at the least cost."""
    one = plus(_steps("u", (INSERT, "I")), _steps("a", (INSERT, "I")))
    out = _always((0, ""))
    for _ in range(3):
        out = plus(_always((0, "")), times(one, out))
    return out


@lru_cache(maxsize=64)
def turn_matrix(initial: str, fault: str) -> Matrix:
    """Keep, rerole or delete one turn, then insert."""
    out = _always((DELETE, "D"))
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED if fault == "truncated" else 0
        for edit in (_steps(initial, (more, "K")), _steps("u", (REROLE + more, "R")), _steps("a", (REROLE + more, "R"))):
            out = plus(out, edit)
    return times(out, closure())


def product(matrices: list[Matrix]) -> Matrix:
    """Product in order, neighbours first, so that audits are joined in a balanced tree."""
    while len(matrices) > 1:
        matrices = [times(*matrices[k : k + 2]) if k + 1 < len(matrices) else matrices[k] for k in range(0, len(matrices), 2)]
    return matrices[0] if matrices else closure()


def cheapest(matrix: Matrix) -> tuple[int, str]:
    return min(x for x in (matrix[0], matrix[3]) if x is not None)


def fault_of(text: str) -> str:
    left = text.strip(SPACES)
    return "blank" if not left else "truncated" if left[-1] not in ENDS else ""


def summary(rows: Iterable[tuple[int | None, str, str, int]]) -> dict[str, Any]:
    """Facts of turns in order, given as (turn, role initial, fault, copies); further copies of a turn are duplicates."""
    out: dict[str, Any] = dict.fromkeys(COUNTS, 0) | {"low": None, "high": None, "turns": 0, "first_turn": None, "last_turn": None, "first_role": None, "last_role": None}
    matrices = [closure()]
    for turn, initial, fault, copies in rows:
        for copy in range(copies):
            now = "duplicate" if copy and fault != "blank" else fault
            if now:
                out[now] += 1
            if out["last_role"] is None:
                out["first_role"], out["first_turn"] = initial, turn
            elif out["last_role"] + initial not in ("su", "ua", "au"):
                out["illegal"] += 1
            out["last_role"] = initial
            if turn is not None and turn != out["last_turn"]:
                out["turns"] += 1
                out["low"] = turn if out["low"] is None else out["low"]
                out["high"] = turn
            out["last_turn"] = turn
            matrices.append(turn_matrix(initial, now))
    return out | {"matrix": product(matrices)}


def joined(parts: list[dict[str, Any]]) -> dict[str, Any]:
    """Facts of neighbouring blocks as those of one."""
    out = dict(parts[0])
    for x in parts[1:]:
        for name in COUNTS:
            out[name] += x[name]
        if x["first_role"] is None:
            continue
        if out["first_role"] is None:
            out |= {k: x[k] for k in ("first_role", "first_turn")}
        else:
            out["illegal"] += out["last_role"] + x["first_role"] not in ("su", "ua", "au")
        out["turns"] += x["turns"] - (x["first_turn"] is not None and x["first_turn"] == out["last_turn"])
        out["low"] = x["low"] if out["low"] is None else out["low"]
        out["high"] = out["high"] if x["high"] is None else x["high"]
        out |= {k: x[k] for k in ("last_role", "last_turn")}
    return out | {"matrix": product([x["matrix"] for x in parts])}


def told(facts: dict[str, Any]) -> dict[str, Any]:
    """What the result says of a conversation, but for the hash."""
    cost, audit = cheapest(facts["matrix"])
    gaps = 0 if facts["low"] is None else facts["high"] - facts["low"] + 1 - facts["turns"]
    return {"gaps": gaps if gaps < 1 << 63 else None, "cost": cost, "audit": audit} | {k: facts[k] for k in COUNTS}


class Walk:
    """Carries an audit out on turns that come in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.count = audit, 0, 0, 0
        self.hash = hashlib.sha256()

    def _put(self, role: str, text: str) -> tuple[int, str, str]:
        self.hash.update(f"{chr(10) if self.count else ''}{role}:{text}".encode())
        self.state = {"s": 1, "u": 2, "a": 3}[role[0]]
        self.count += 1
        return self.count - 1, role, text

    def _next_role(self) -> str:
        return "assistant" if self.state == 2 else "user"

    def inserts(self) -> Iterator[tuple[int, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._put(self._next_role(), "")

    def row(self, role: str, text: str, copies: int) -> Iterator[tuple[int, str, str]]:
        for _ in range(copies):
            yield from self.inserts()
            edit = self.audit[self.at]
            self.at += 1
            if edit != "D":
                yield self._put(role if edit == "K" else self._next_role(), text)


class _Out:
    """Rows of a schema, handed on in batches of few rows and bytes."""

    def __init__(self, schema: str):
        self.names = [x.split()[0] for x in schema.split(", ")]
        kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
        self.schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])
        self.rows: list[dict[str, Any]] = []
        self.size = 0

    def add(self, size: int = 0, **row: Any) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += size
        if len(self.rows) >= BATCH or self.size >= WHOLE_BYTES:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in self.rows], self.schema.field(k).type) for k in self.names], schema=self.schema)
        self.rows, self.size = [], 0


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch[n].to_pylist() for n in names), strict=True)


def _print(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()


def _scan(turns: bool, whole_bytes: int):
    """Finish the conversations that a task holds whole; hand on the rows of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out = TaskContext.get().partitionId(), _Out(SCANNED)
        conv, held, size, first, seen, n = None, [], 0, True, set(), 0

        def open_rows() -> Iterator[pa.RecordBatch]:
            nonlocal n
            for turn, role, text, copies in held:
                mark = _print(role, text)
                yield from out.add(len(text), kind=OPEN_ROW, conv_id=conv, part=part, n=n, turn=turn, role=role, text=text, copies=copies, print=mark, first=copies > 0 and mark not in seen, fault=fault_of(text))
                n += 1
                if copies:
                    seen.add(mark)
            held.clear()

        def finish() -> Iterator[pa.RecordBatch]:
            known, facts = set(), []
            for turn, role, text, copies in held:
                fault = fault_of(text)
                if copies and fault != "blank":
                    fault = "duplicate" if (role, text) in known else fault
                    known.add((role, text))
                facts.append((turn, role[:1], fault, copies))
            result = told(summary(facts))
            walk = Walk(result["audit"])
            for _, role, text, copies in held:
                for place, new_role, new_text in walk.row(role, text, copies):
                    if turns:
                        yield from out.add(len(new_text), kind=TURN, conv_id=conv, n=place, role=new_role, text=new_text)
            for place, new_role, new_text in walk.inserts():
                if turns:
                    yield from out.add(kind=TURN, conv_id=conv, n=place, role=new_role, text=new_text)
            yield from out.add(len(result["audit"]), kind=CONVERSATION, conv_id=conv, repaired_sha256=walk.hash.hexdigest(), **result)
            held.clear()

        started = large = False
        for now, turn, role, text, copies in _rows(batches, "conv_id", "turn", "role", "text", "copies"):
            if started and now != conv:
                yield from open_rows() if first or large else finish()
                size, first, large, n = 0, False, False, 0
                seen.clear()
            started, conv = True, now
            held.append((turn, role, text, copies))
            size += len(text) + 100
            if size > whole_bytes:
                large, size = True, 0
                yield from open_rows()
        # the next task may hold more of the last one, as may the one before of the first
        yield from open_rows()
        yield from out.rest()

    return run


def _packed(facts: dict[str, Any]) -> dict[str, Any]:
    matrix = facts.pop("matrix")
    return facts | {"costs": [x and x[0] for x in matrix], "audits": [x and x[1] for x in matrix]}


def _unpacked(row: dict[str, Any]) -> dict[str, Any]:
    return row | {"matrix": [None if c is None else (c, a) for c, a in zip(row["costs"], row["audits"], strict=True)]}


def _grouped(rows: Iterator[tuple]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Runs of rows with equal first two values."""
    return groupby(rows, key=lambda r: r[:2])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = _Out(FACTS)
    for (conv, part), rows in _grouped(_rows(batches, "conv_id", "part", "turn", "initial", "fault", "copies")):
        yield from out.add(conv_id=conv, block=part, **_packed(summary(r[2:] for r in rows)))
        yield from out.rest()


def _round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = _Out(FACTS)
    for (conv, block), rows in _grouped(_rows(batches, "conv_id", "above", *out.names[2:])):
        parts = [_unpacked(dict(zip(out.names[2:], r[2:], strict=True))) for r in rows]
        yield from out.add(conv_id=conv, block=block, **_packed(joined(parts)))
        yield from out.rest()


def _finish(turns: bool):
    """Audits of conversations, each followed by the conversation's rows in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, walk, about = _Out(TURNS if turns else WALKED), None, {}

        def end() -> Iterator[pa.RecordBatch]:
            for place, role, text in walk.inserts() if walk else ():
                if turns:
                    yield from out.add(conv_id=about["conv_id"], place=place, role=role, text=text)
            if walk and not turns:
                yield from out.add(len(about["audit"]), repaired_sha256=walk.hash.hexdigest(), **about)

        names = [n for n in RESULT if n != "repaired_sha256"]
        for conv, part, role, text, copies, *result in _rows(batches, "conv_id", "part", "role", "text", "copies", *names):
            if part < 0:
                yield from end()
                about = {"conv_id": conv, **dict(zip(names, result, strict=True))}
                walk = Walk(about["audit"])
                continue
            for place, new_role, new_text in walk.row(role, text, copies):
                if turns:
                    yield from out.add(len(new_text), conv_id=conv, place=place, role=new_role, text=new_text)
        yield from end()
        yield from out.rest()

    return run


def _told_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = _Out(WALKED)
    names = _Out(FACTS).names[2:]
    for conv, *row in _rows(batches, "conv_id", *names):
        facts = _unpacked(dict(zip(names, row, strict=True)))
        yield from out.add(conv_id=conv, **told(facts))
        yield from out.rest()


def repair(rows: DataFrame, *, turns: bool = False, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """Repair ``rows(conv_id, turn, role, text)``, which may say in ``copies`` how often a row stands there, 0 included.

    One row for each conversation: ``gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``. With
    ``turns``, the repaired turns themselves: ``conv_id, place, role, text``.
    """
    scope = Scope(rows.sparkSession)
    known = F.col("copies").cast("int") if "copies" in rows.columns else F.lit(1)
    text = {c: F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")}
    narrow = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text["role"], text["text"], known.alias("copies"))
    dealt = narrow.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("conv_id", "turn", "role", "text")
    scanned = scope.saved(dealt.mapInArrow(_scan(turns, whole_bytes), SCANNED), "conversations")
    opened = scanned.where(F.col("kind") == OPEN_ROW)

    # faults: within a block a row is known to be the first of its role and text; of those, the first block's counts
    facts = opened.select("conv_id", "part", "n", "turn", F.substring("role", 1, 1).alias("initial"), "copies", "print", "first", "fault")
    place = F.row_number().over(Window.partitionBy("conv_id", "print").orderBy("part", "n"))
    firsts = facts.where("first").withColumn("repeated", place > 1)
    facts = firsts.unionByName(facts.where("NOT first").withColumn("repeated", F.lit(True)))
    fault = F.when((F.col("fault") != "blank") & F.col("repeated"), "duplicate").otherwise(F.col("fault")).alias("fault")
    facts = facts.select("conv_id", "part", "n", "turn", "initial", fault, "copies")
    level = facts.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "n").mapInArrow(_blocks, FACTS)

    width = (opened.agg(F.max("part")).first()[0] or 0) + 1
    while width > 1:
        above = level.withColumn("above", F.expr(f"block div {FAN}"))
        level = above.repartition("conv_id", "above").sortWithinPartitions("conv_id", "above", "block").mapInArrow(_round, FACTS)
        width = -(-width // FAN)
    audits = level.mapInArrow(_told_rows, WALKED).withColumn("part", F.lit(-1)).withColumn("n", F.lit(-1).cast("long"))
    both = audits.unionByName(opened.select("conv_id", "part", "n", "role", "text", "copies"), allowMissingColumns=True)
    ended = both.repartition("conv_id").sortWithinPartitions("conv_id", "part", "n").mapInArrow(_finish(turns), TURNS if turns else WALKED)
    if turns:
        return scanned.where(F.col("kind") == TURN).select("conv_id", F.col("n").alias("place"), "role", "text").unionByName(ended)
    return scanned.where(F.col("kind") == CONVERSATION).select("conv_id", *RESULT).unionByName(ended)


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with faults put in by the checksum of their conversation and turn; dropped ones have 0 ``copies``."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(named[0], F.lit(":"), named[1])) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return conversations.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind <= 1, "").when(kind == 2, F.translate(text, ENDS, "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
