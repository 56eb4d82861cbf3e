"""Operators on small inputs with known results."""

from __future__ import annotations

import struct

import pytest
from pyspark.sql import functions as F

from skein.functions.text import importance, relevance, short_id, trimmed, utf16_length
from skein.operators import discovery, graph, loadouts, research, search, symbols
from skein.sources import code_view, vectors
from skein.streaming import metrics


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def code(spark, *files):
    return symbols.line_table(spark.createDataFrame(list(files), "path string, content string"))


COUNTS = "name string, category string, ea int, es int, v int, dep int, opts int, it int, par int, threshold double, sections int, density int, checks int"
GOLDEN = [
    (("Deep", "core", 4, 4, 4, 5, 31, 4, 3, 0.85, 8, 5000, 0), (80.5, "moderate", 100, 100, 25, 49000, 8.0, 5.2394, "intensive", 59.975)),
    (("Quick", "core", 3, 3, 2, 3, 23, 2, 5, 0.7, 5, 2000, 0), (57.75, "very-fast", 65, 60, 16, 20000, 1.8, 13.2946, "intensive", 59.9125)),
]


def test_loadout_metrics(spark):
    rows = loadouts.metrics(spark.createDataFrame([g[0] for g in GOLDEN], COUNTS)).collect()
    for r, (_, want) in zip(rows, GOLDEN, strict=True):
        got = (r.complexity, r.speed, r.thoroughness, r.accuracy, r.reliability, r.tokens, r.minutes, round(r.cost_benefit, 4), r.level, r.benchmark)
        assert [pytest.approx(w) if isinstance(w, float) else w for w in want] == list(got)


@pytest.mark.parametrize(
    ("query", "text", "path", "want"),
    [("testFunction", "function testFunction() { return true; }", "a.ts", 0.5), ("query", "some content", "a.ts", 0.1), ("query", "some content", "a.py", 0.0), (" test", "content test", "a.py", 0.8)],
)
def test_relevance(spark, query, text, path, want):
    assert one(spark, relevance(F.lit(text), F.lit(path), query)) == pytest.approx(want)


def test_text(spark):
    assert one(spark, utf16_length(F.lit("a😀"))) == 3
    assert one(spark, trimmed(F.lit("\t\u00a0a b\n"))) == "a b"
    assert one(spark, short_id(F.lit("/home/user/project"))) == "L2hvbWUvdXNlci9w"
    score = {p: one(spark, importance(F.lit(p))) for p in ("package.json", "deep/nested/file.ts", "index.ts")}
    assert min(score["package.json"], score["index.ts"]) > score["deep/nested/file.ts"]


def test_symbols(spark):
    ts = "export function testFunction(param: string): void {\nasync function asyncFunction() {}\nexport class TestClass {}\ninterface Inner {}\nimport React from 'react'"
    py = "import os\nfrom pathlib import Path\nimport json as jsonlib\nclass A:\n    def method(self):\n        pass"
    found = symbols.extract_symbols(code(spark, ("a.ts", ts), ("b.py", py), ("c.py", ""), ("d.rs", "function x"))).collect()
    assert {(r.path, r.symbol, r.type) for r in found} == {("a.ts", "testFunction", "def"), ("a.ts", "asyncFunction", "def"), ("a.ts", "TestClass", "def"), ("a.ts", "Inner", "def"), ("a.ts", "react", "ref"), ("b.py", "os", "ref"), ("b.py", "pathlib", "ref"), ("b.py", "json", "ref"), ("b.py", "A", "def"), ("b.py", "method", "def")}
    place = symbols.extract_symbols(code(spark, ("a.ts", "line 0\nfunction test() {\n  return true;\n}"))).first()
    assert (place.start, place.end) == (7, 24)


def test_call_graph(spark):
    text = "function caller() {\n  callee1(); callee2()\n}\nfunction callee1() {\n  helper()\n}\nfunction helper() {\n}\nfunction recursive(n) {\n  if (n) recursive(n)\n  helper()\n}"
    edges = {(r.caller, r.callee) for r in symbols.call_edges(code(spark, ("a.js", text))).collect()}
    assert edges == {("caller", "callee1"), ("caller", "callee2"), ("callee1", "helper"), ("helper", None), ("recursive", "if"), ("recursive", "helper")}


def test_change_set(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", "1")], "path string, hash string")
    new = spark.createDataFrame([("b", "1"), ("c", "2"), ("d", None), ("e", "1")], "path string, hash string")
    assert {(r.path, r.change) for r in discovery.change_set(old, new).collect()} == {("a", "removed"), ("c", "modified"), ("d", "modified"), ("e", "added")}


def test_pagerank_sums_to_one(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "d")], "source string, target string")
    ranks = {r.node: r["rank"] for r in graph.pagerank(edges, 10).collect()}
    assert sum(ranks.values()) == pytest.approx(1) and ranks["a"] > ranks["d"]


def test_budget(spark):
    shape = "report string, ord long, title string, category string, priority double, tokens long"
    rows = [("r", 1, "exec", "executive", 1.0, 300), ("r", 2, "big", "a", 0.9, 5000), ("r", 3, "small", "a", 0.8, 200), ("r", 4, "last", "a", 0.7, 100)]
    kept = research.within_budget(spark.createDataFrame(rows, shape), "report", 1000, 1500).collect()
    assert [(r.title, r.tokens, r.cut) for r in kept] == [("exec", 300, False), ("big (Truncated)", 700, True)]
    # the executive section stays and comes first, whatever its size and priority; a second one goes
    rows = [("r", 1, "fits", "a", 0.9, 100), ("r", 2, "exec", "executive", 0.1, 3000), ("r", 3, "more", "executive", 0.05, 10)]
    kept = research.within_budget(spark.createDataFrame(rows, shape), "report", 1000, 1500).collect()
    assert [(r.title, r.tokens, r.cut) for r in kept] == [("exec", 3000, False)]
    assert research.within_budget(spark.createDataFrame([], shape), "report", 1000, 1500).collect() == []


def test_convergence(spark):
    rows = [("r", 1, "x", 0.8), ("r", 1, "y", 0.7), ("r", 2, "x", 0.85), ("r", 2, "y", 0.8)]
    out = research.convergence(spark.createDataFrame(rows, "run string, iteration int, category string, confidence double")).orderBy("iteration").collect()
    assert [r.convergence for r in out] == [0, pytest.approx(0.925)]


def test_binary_and_scan(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "main.ts").write_text("let a = 1")
    (tmp_path / "node_modules" / "x.js").write_text("x")
    (tmp_path / "data.bin").write_bytes(bytes([0, 1, 2, 255]))
    scan = code_view.scan_repository(spark, str(tmp_path), excludes=["node_modules/"])
    assert {r.path for r in scan.collect()} == {"src/main.ts", "data.bin"}
    assert [r.content for r in code_view.decoded(scan).collect()] == ["let a = 1"]


def test_vector_files(spark, tmp_path):
    (tmp_path / "v.bin").write_bytes(struct.pack("<II4f", 2, 2, 1, 2, 3, 4))
    (tmp_path / "broken.bin").write_bytes(b"abc")
    assert [(r.ordinal, r.embedding) for r in vectors.read_vector_files(spark, str(tmp_path)).orderBy("ordinal").collect()] == [(0, [1, 2]), (1, [3, 4])]


def test_stream_is_batch(spark, sf_dir, tmp_path):
    path = f"{sf_dir}/events.parquet"
    batch = spark.read.parquet(path)
    folder = tmp_path / "in"
    batch.repartition(3).write.parquet(str(folder))
    stream = metrics.windowed_means(metrics.read_events(spark, str(folder), batch.schema), width="1 day", late="400 days")
    run = stream.writeStream.format("memory").queryName("means").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    want = metrics.windowed_means(batch, width="1 day")
    pick = ["event_type", "window_start", "n"]
    assert sorted(map(tuple, spark.table("means").select(*pick).collect())) == sorted(map(tuple, want.select(*pick).collect()))


def test_upsert(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    shape = "path string, at long, hash string"
    batches = [[("a", 1, "x"), ("b", 1, "y")], [("a", 2, "z")], [("c", 1, "w"), ("a", 1, "old")]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(folder)
        # the last batch comes with a fresh checkpoint, which sees all files again
        checkpoint = str(tmp_path / ("cp" if k < 2 else "fresh"))
        run = metrics.upsert_latest(metrics.read_events(spark, folder, shape), out, checkpoint, "path", "at", buckets=4).trigger(availableNow=True).start()
        run.awaitTermination(120)
        assert run.exception() is None
    found = {r.path: (r["at"], r["hash"]) for r in metrics.read_latest(spark, out, shape).collect()}
    assert found == {"a": (2, "z"), "b": (1, "y"), "c": (1, "w")}
    spark.createDataFrame([("d", 1, "n")], shape).coalesce(1).write.parquet(str(tmp_path / "other"))
    metrics.upsert_latest(metrics.read_events(spark, str(tmp_path / "other"), shape), out, str(tmp_path / "third"), "path", "at", buckets=4).trigger(availableNow=True).start().awaitTermination(120)
    assert {r.path for r in metrics.read_latest(spark, out, shape).collect()} == {"a", "b", "c", "d"}
    assert len(list((tmp_path / "out" / "manifest").iterdir())) <= 2


def test_scan_of_odd_folder_names(spark, tmp_path):
    root = tmp_path / "c++ (old)"
    (root / "src").mkdir(parents=True)
    (root / "src" / "a.ts").write_text("let a")
    (root / "src" / "b.py").write_text("b = 1")
    (root / "dist").mkdir()
    (root / "dist" / "c.ts").write_text("let c")
    scan = code_view.scan_repository(spark, str(root), languages=["typescript"], excludes=["dist/"])
    assert [r.path for r in scan.collect()] == ["src/a.ts"]
    assert tuple(code_view.size_of(scan).first()) == (1, 5)


def test_order_of_agents(spark):
    shape = "ord int, name string, enabled boolean, dependencies array<string>"
    rows = [(1, "c", True, ["a", "x"]), (2, "a", True, ["off"]), (3, "off", False, None), (4, "b", True, [])]
    assert graph.expanded_order(spark.createDataFrame(rows, shape)) == ["off", "a", "x", "c", "b"]
    with pytest.raises(ValueError):
        graph.expanded_order(spark.createDataFrame([(1, "a", True, ["b"]), (2, "b", True, ["a"])], shape))


def test_rate_limit(spark):
    import random

    from skein.operators import telemetry

    rng = random.Random(2)
    rows = [(f"c{rng.randrange(3)}", k, float(rng.randrange(200)) / 4) for k in range(300)] + [(None, 300, 1.0), ("c0", 301, None)]
    table = spark.createDataFrame(rows, "client string, id long, t double").selectExpr("client", "id", "timestamp_millis(cast(t * 1000 as bigint)) as ts")
    found = {r.id: r.allowed for r in telemetry.limited(table, "client", "id", rate=1.0, burst=3.0).collect()}
    want = {301: False}
    for c in {r[0] for r in rows}:
        held, seen = 0.0, None
        for _, k, t in sorted((r for r in rows if r[0] == c and r[2] is not None), key=lambda r: (r[2], r[1])):
            left = 0.0 if seen is None else max(0.0, held - (t - seen))
            want[k] = left <= 3.0
            if want[k]:
                held, seen = left + 1, t
    assert found == want and not all(want.values())


def test_project_stats_skip_built_and_hidden(spark):
    paths = ["src/index.ts", "node_modules/a.js", "dist/b.ts", ".git/c.py", "src/.hidden.py", "a/build/d.ts", "e.py"]
    row = discovery.project_stats(spark.createDataFrame([(p, 1) for p in paths], "path string, size long")).first()
    assert (row.total_files, row.typescript_files, row.javascript_files, row.python_files) == (2, 1, 0, 1)


def test_configurations_with_errors(spark, tmp_path):
    from skein.sources import loadouts as files

    (tmp_path / "good.json").write_text('{"name": "n", "agents": [{"name": "a", "enabled": true}], "output": {"densityTarget": 1}, "pipeline": {"maxIterations": 2}}')
    (tmp_path / "bad.json").write_text('{"name": ')
    (tmp_path / "other.yml").write_text("name: y\n")
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.read_loadouts(spark, str(tmp_path)).collect()}
    assert rows["good.json"].name == "n" and rows["good.json"].error is None
    assert rows["bad.json"].error and rows["bad.json"].name is None
    assert (rows["other.yml"].name == "y") != bool(rows["other.yml"].error)
    row = files.overridden(files.read_loadouts(spark, str(tmp_path)).where("name = 'n'"), density=9, iterations=0).first()
    assert (row.output.densityTarget, row.pipeline.maxIterations) == (9, 2)


def test_ranked_lists(spark):
    rows = [(f"l{k % 2}", k, float(k % 7)) for k in range(200)] + [("l0", 500, 3.0)]
    found = {(r["list"], r["id"]): r["rank"] for r in search.ranked_lists(spark.createDataFrame(rows, "list string, id long, score double")).collect()}
    for name in ("l0", "l1"):
        own = sorted((r for r in rows if r[0] == name), key=lambda r: (-r[2], r[1]))
        assert [found[name, r[1]] for r in own] == list(range(1, len(own) + 1))
