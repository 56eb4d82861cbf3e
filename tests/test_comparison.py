"""Comparison of configurations, running totals, places of lines and chunks against plain versions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from skein.operators import chunks, discovery, loadouts, symbols

SCORED = "ord int, name string, speed string, parallelism double, thoroughness double, reliability double, cost_benefit double, benchmark double, complexity double, expertise string, domains array<string>"
ROWS = [
    (0, "a", "fast", 3.0, 50.0, 10.0, 1.5, 60.4, 10.0, "specialized", ["x"]),
    (1, "b", "very-fast", 2.5, 90.0, 20.0, 7.5, 60.5, 10.0, "expert", ["y", "z"]),
    (2, "c", "very-fast", 10.0, 90.0, 30.0, None, 60.5, 30.0, "expert", ["security"]),
    (3, "d", "slow", 1.0, 20.0, 40.0, 7.5, 10.0, None, "specialized", ["w"]),
]


def test_matrix(spark):
    df = spark.createDataFrame(ROWS, SCORED)
    got = {(r.name, r.metric): (r.value, r["rank"], r.percentile) for r in loadouts.comparison_matrix(df).collect()}
    assert len(got) == 20
    assert [got[n, "thoroughness"] for n in "abcd"] == [(50.0, 3, 50), (90.0, 1, 100), (90.0, 1, 100), (20.0, 4, 25)]
    assert [got[n, "complexity"] for n in "abcd"] == [(10.0, 2, 75), (10.0, 2, 75), (30.0, 1, 100), (0.0, 4, 25)]
    assert [got[n, "cost_benefit"][1] for n in "abcd"] == [3, 1, 4, 1]
    few = loadouts.comparison_matrix(df, ["d", "missing", "a"]).collect()
    assert len(few) == 10 and {r.percentile for r in few} == {50, 100}
    assert loadouts.comparison_matrix(df.limit(0)).collect() == []


def test_advice(spark):
    df = spark.createDataFrame(ROWS, SCORED)
    got = [(r.category, r.loadout, r.reason, r.confidence, len(r.tradeoffs)) for r in loadouts.advice(df).collect()]
    assert got == [
        ("speed", "c", "Optimized for speed with very-fast performance and 10/10 parallelism", 85, 1),
        ("quality", "b", "Highest quality score: 90 thoroughness, 20 reliability", 90, 0),
        ("cost", "b", "Best cost-benefit ratio: 8/100 efficiency score", 80, 0),
        ("specialization", "c", "expert expertise in security", 75, 2),
        ("general", "b", "Highest overall benchmark score: 61/100", 95, 0),
    ]
    plain = loadouts.advice(df.withColumn("expertise", F.lit("generalist")).where("ord IN (0, 3)")).collect()
    assert [(r.category, r.loadout) for r in plain] == [("speed", "a"), ("quality", "a"), ("cost", "d"), ("general", "a")]
    assert loadouts.advice(df.limit(0)).collect() == []


def test_running_total_and_shards(spark):
    pick = random.Random(5)
    rows = [(f"p{k:04}", pick.choice([None, 0, *range(1, 50)])) for k in range(500)]
    df = spark.createDataFrame(pick.sample(rows, 500), "path string, size long")
    got = {r.path: r.running for r in discovery.running_total(df, "size", [F.desc("path")]).collect()}
    total = 0
    for path, size in sorted(rows, reverse=True):
        total += size or 0
        assert got[path] == total
    shards = {r.path: r.shard for r in discovery.sharded(df, 1000).collect()}
    before = 0
    for path, size in rows:
        assert shards[path] == before // 1000
        before += size or 0
    assert discovery.within_budget(df, 3000, [F.col("path")]).agg(F.sum("size")).first()[0] <= 3000
    assert discovery.running_total(df.limit(0), "size", [F.col("path")]).collect() == []
    assert tuple(discovery.bundle_size(df.limit(0)).first()) == (0, False, 1)


@pytest.mark.parametrize("n", [1, 2, 127, 128, 129, 1000])
def test_line_starts(spark, n):
    pick = random.Random(n)
    lines = [pick.choice(["", "a", "é😀", "long line " * 3]) for _ in range(n)]
    text = "\n".join(lines)
    rows = symbols.line_table(spark.createDataFrame([("f", text), ("none", None), ("empty", "")], "path string, content string")).collect()
    own = sorted((r.line_no, r.line, r.start) for r in rows if r.path == "f")
    at, want = 0, []
    for k, line in enumerate(lines):
        want.append((k, line, at))
        at += len(line.encode("utf-16-le")) // 2 + 1
    assert own == want
    assert [(r.line_no, r.line, r.start) for r in rows if r.path == "empty"] == [(0, "", 0)] and not [r for r in rows if r.path == "none"]


def test_call_order(spark):
    code = "def f(x):\n    b(a(c(x)))\n    a(d(x))\ndef g(x):\n    pass"
    lines = symbols.line_table(spark.createDataFrame([("a.py", code)], "path string, content string"))
    got = sorted((r.caller, r.ord or 0, r.callee) for r in symbols.call_edges(lines).collect())
    assert got == [("f", 1, "b"), ("f", 2, "a"), ("f", 3, "c"), ("f", 4, "d"), ("g", 0, None)]


def test_resolved_once(spark):
    rows = [("a", 1, "f", "def"), ("b", 1, "f", "def"), ("b", 2, "f", "ref"), ("c", 3, "f", "ref"), ("c", 4, "none", "ref")]
    got = symbols.resolved_once(spark.createDataFrame(rows, "path string, line_no int, symbol string, type string")).collect()
    assert sorted((r.ref_path, r.line_no, r.def_path, r.definitions) for r in got if r.def_path) == [("b", 2, "b", 2), ("c", 3, "a", 2)]
    assert [(r.symbol, r.definitions) for r in got if not r.def_path] == [("none", 0)]


def test_chunks_of_odd_texts(spark):
    files = spark.createDataFrame([("a", "x" * 60), ("b", None), ("c", ""), ("d", "\n".join(["y" * 30] * 25))], "path string, content string")
    got = sorted((r.path, r.first_line, len(r.chunk)) for r in chunks.line_chunks(files, 100).collect())
    assert got == [("a", 0, 60), ("d", 0, 309), ("d", 10, 309), ("d", 20, 154)]
    texts = spark.createDataFrame([(1, None), (2, " "), (3, "a b c d e f g h i j")], "doc_id int, text string")
    assert [(r.doc_id, r.chunk_no, r.chunk) for r in chunks.token_chunks(texts, 4, 1).collect()] == [(3, 0, "a b c d"), (3, 1, "d e f g"), (3, 2, "g h i j")]
