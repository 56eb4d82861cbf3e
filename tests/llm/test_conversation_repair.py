"""Conversation repair against a plain search over edits and a plain walk over rows."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from skein.llm import conversation_repair as repair
from skein.llm.queries import QUERIES

SPACES = " \t\n\v\f\r"
COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        kept = out[conv]
        key = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if key == 0:
            continue
        text = "" if key == 1 else re.sub("[.!?]", "", text) if key == 2 else text
        role = "user" if key == 4 else role
        kept += [(turn, role, text)] * (2 if key == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        left = text.strip(SPACES)
        out.append("blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def best_edits(rows, fault):
    """Least (cost, audit) by searching edits outright: states are (rows done, roles so far as a pattern state)."""
    legal = {("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")}
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, k, last = heapq.heappop(heap)
        if k == len(rows) and last in ("", "a"):
            return cost, audit
        if (k, last) in done:
            continue
        done.add((k, last))
        for r in "ua":
            if (last, r) in legal:
                heapq.heappush(heap, (cost + 5, audit + "I", k, r))
        if k == len(rows):
            continue
        heapq.heappush(heap, (cost + 2, audit + "D", k + 1, last))
        if fault[k] in ("blank", "duplicate"):
            continue
        more = 5 if fault[k] == "truncated" else 0
        if (last, rows[k][1][:1]) in legal:
            heapq.heappush(heap, (cost + more, audit + "K", k + 1, rows[k][1][:1]))
        for r in "ua":
            if (last, r) in legal:
                heapq.heappush(heap, (cost + more + 1, audit + "R", k + 1, r))


def carried_out(rows, audit):
    out, rows = [], iter(rows)
    for edit in audit:
        new = "assistant" if out and out[-1][0][:1] == "u" else "user"
        if edit == "I":
            out.append((new, ""))
            continue
        _, role, text = next(rows)
        if edit != "D":
            out.append((role if edit == "K" else new, text))
    assert next(rows, None) is None
    assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out))
    return out


def plain(rows):
    out = {}
    for conv, own in damaged(rows).items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        fault = faults(own)
        cost, audit = best_edits(own, fault)
        turns = {t for t, *_ in own if t is not None}
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:], strict=False)]
        kept = carried_out(own, audit)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *(fault.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs),
            cost,
            audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest(),
        )
    return out


def found(df):
    rows = df.select("conv_id", *COLUMNS).collect()
    out = {r[0]: tuple(r[1:]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_op12(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(QUERIES["op12_conversation_repair"](spark, sf_dir)) == plain(rows)


def made(seed, conversations, long):
    pick = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "", None, "ua", "Assistant", "tool"]
    texts = ["Yes.", "No!", "cut", "", " \t\n", "\xa0", None, "a. ", "b", "語?", "x" * 50 + ".", "!", "same."]
    rows = []
    for conv in [None, *range(conversations)]:
        n = long if conv == 3 else pick.randint(1, 9)
        rows += [(conv, pick.choice([None, -5, 1 << 40, *[k] * 9]), pick.choice(roles), pick.choice(texts) if pick.random() < 0.6 else f"t{pick.randint(0, n * 2)}.") for k in range(n)]
    rows += [(3, k, "user" if k % 2 else "assistant", "hot.") for k in range(long, long + 200)]
    rows += rows[:40]
    pick.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(("seed", "whole_bytes"), [(1, repair.WHOLE_BYTES), (2, 600), (3, 1)])
def test_odd_conversations(spark, seed, whole_bytes):
    """Nulls, ties, copies, odd roles; a conversation over many partitions; blocks of any size give the same."""
    rows = made(seed, 60, 1500)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS part", "'x' AS audit")
    assert found(repair.repair(repair.damage(df), whole_bytes=whole_bytes)) == plain(rows)


def test_repaired_turns(spark):
    rows = made(4, 40, 300)
    df = spark.createDataFrame(rows, SCHEMA)
    for whole_bytes in (repair.WHOLE_BYTES, 1):
        turns = defaultdict(list)
        for r in sorted(repair.repair(repair.damage(df), turns=True, whole_bytes=whole_bytes).collect(), key=lambda r: (str(r.conv_id), r.place)):
            assert r.place == len(turns[r.conv_id])
            turns[r.conv_id].append(f"{r.role}:{r.text}")
        for conv, want in plain(rows).items():
            assert hashlib.sha256("\n".join(turns[conv]).encode()).hexdigest() == want[-1]


def test_all_dropped_and_empty(spark):
    gone = [(c, 0, "user", "Hi.") for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert len(gone) > 5
    empty = hashlib.sha256(b"").hexdigest()
    got = found(repair.repair(repair.damage(spark.createDataFrame(gone, SCHEMA))))
    assert got == {c: (0, 0, 0, 0, 0, 0, "", empty) for c, *_ in gone}
    assert repair.repair(repair.damage(spark.createDataFrame([], SCHEMA))).collect() == []


def test_products_are_associative():
    pick = random.Random(9)
    classes = [(i, f) for i in ("s", "u", "a", "x", "") for f in ("", "truncated", "blank", "duplicate")]
    for _ in range(300):
        ms = [repair.turn_matrix(*pick.choice(classes)) for _ in range(pick.randint(1, 9))]
        left = repair.closure()
        for m in ms:
            left = repair.times(left, m)
        cut = pick.randint(0, len(ms))
        assert repair.times(repair.product([repair.closure(), *ms[:cut]]), repair.product([repair.closure(), *ms[cut:]])) == left
        assert repair.product([repair.closure(), *ms]) == left


def test_very_long_text(spark):
    rows = [(1, 0, "user", "a " * 3_000_000 + "."), (1, 1, "assistant", "b. " + " " * 2_000_000), (2, 0, "user", "q?")]
    assert found(repair.repair(repair.damage(spark.createDataFrame(rows, SCHEMA)))) == plain(rows)
