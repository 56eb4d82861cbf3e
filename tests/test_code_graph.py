"""Components, paths, answers, fuzzy names, packages and cluster trees against plain versions."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import answers, cluster_tree, fuzzy_index, graph, workspaces


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "source long, target long")


def reach(pairs):
    out = {n: {n} for p in pairs for n in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            more = out[b] - out[a]
            if more:
                out[a] |= more
                changed = True
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_strong_components(spark, seed):
    pick = random.Random(seed)
    pairs = [(pick.randint(0, 30), pick.randint(0, 30)) for _ in range(35)] + [(100, 101), (101, 102), (102, 100), (200, 200), (300, 301)]
    to = reach(pairs)
    want = {n: min(m for m in to[n] if n in to[m]) for n in to}
    rows = graph.strong_components(edges_of(spark, [*pairs, *pairs[:5], (None, 1), (1, None)])).collect()
    assert {r.node: r.component for r in rows} == want and len(rows) == len(want)
    assert all(r.size == sum(c == r.component for c in want.values()) for r in rows)


def test_circles_and_empty(spark):
    found = graph.circles(edges_of(spark, [(1, 2), (2, 1), (3, 3), (4, 5)])).collect()
    assert sorted((r.component, r["size"], r.nodes) for r in found) == [(1, 2, [1, 2]), (3, 1, [3])]
    assert graph.strong_components(edges_of(spark, [])).collect() == []


def test_shortest_paths(spark):
    pairs = [(1, 3), (2, 3), (3, 4), (4, 5), (1, 5), (5, 1)]
    found = graph.reached_by(edges_of(spark, pairs), spark.createDataFrame([(2,), (1,), (1,)], "node long"), 3)
    got = {r.node: (r.depth, r.parent, r.path) for r in graph.shortest_paths(found, 3).collect()}
    assert got == {1: (0, None, [1]), 2: (0, None, [2]), 3: (1, 1, [1, 3]), 5: (1, 1, [1, 5]), 4: (2, 3, [1, 3, 4])}


def test_answers(spark):
    code = "def one(x):\n    two(x)\ndef two(x):\n    lost(x)\n"
    files = spark.createDataFrame([("a.py", code), ("b.py", "class Two:\n    pass"), ("c.py", None)], "path string, content string")
    rows = answers.ask("What is called by ONE?", files, context_lines=0).collect()
    assert [(r.ord, r.intent, r.symbol, r.depth, r.way, r.path, r.snippet) for r in rows] == [
        (1, "callgraph", "one", 0, "one", "a.py", "def one(x):"),
        (2, "callgraph", "two", 1, "one -> two", "a.py", "def two(x):"),
        (3, "callgraph", "lost", 2, "one -> two -> lost", "a.py", "    lost(x)"),
    ]
    assert code[rows[1].start : rows[1].end] == "def two(x):"
    assert [(r.symbol, r.depth) for r in answers.ask("Tell me about Two", files).collect()] == [("two", 0), ("Two", 0)] or len(answers.ask("Tell me about Two", files).collect()) == 2
    assert answers.ask("nothing here", files).collect() == []
    assert answers.ask("one", files.limit(0)).collect() == []


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2])
def test_fuzzy_index(spark, edits):
    pick = random.Random(edits)
    base = ["", "a", "ab", "getValue", "get_value", "x" * 38, "x" * 39 + "y", "x" * 40, "x" * 41, "x" * 42, "yx" * 22, "Ünïcode"]
    names = [*base, *("".join(pick.choice("ab_") for _ in range(pick.randint(1, 6))) for _ in range(60)), None, "GETVALUE"]
    asked = [*names[:40], "xx" * 21, "zz", None]
    got = fuzzy_index.lookup(fuzzy_index.index(spark.createDataFrame([(n,) for n in names], "name string"), edits), spark.createDataFrame([(n,) for n in asked], "asked string"), edits)
    want = {(a, n, levenshtein(a, n)) for a in {x.lower() for x in asked if x is not None} for n in {x.lower() for x in names if x is not None} if levenshtein(a, n) <= edits}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_workspaces(spark):
    files = [("a/package.json", 1), ("a/x.ts", 2), ("a/b/c/y.ts", 3), ("a/b/pyproject.toml", 4), ("ab/z.ts", 5), ("top.md", None), (None, 7), ("a/b/pyproject.toml", 4)]
    df = spark.createDataFrame(files, "path string, size long")
    got = workspaces.assigned(df, workspaces.roots(df))
    assert {r.path: r.root for r in got.collect()} == {"a/package.json": "a", "a/x.ts": "a", "a/b/c/y.ts": "a/b", "a/b/pyproject.toml": "a/b", "ab/z.ts": "", "top.md": ""}
    assert sorted(tuple(r) for r in workspaces.totals(got).collect()) == [("", 5, 5 and 2, 2)][:0] + sorted([("", 2, 5, 2), ("a", 2, 3, 2), ("a/b", 3, 11, 2)])
    assert workspaces.assigned(df.limit(0), workspaces.roots(df.limit(0))).collect() == []


@pytest.fixture(scope="module")
def forest(spark, tmp_path_factory):
    pick = np.random.default_rng(2)
    centres = pick.normal(0, 1, (40, 8))
    rows = [(k, (centres[k % 40] + pick.normal(0, 0.05, 8)).tolist()) for k in range(1200)]
    rows += [(2000, None), (2001, [float("nan")] * 8), (2002, [0.0] * 8), (2003, [1.0]), (2004, [None] * 8)]
    tree = cluster_tree.cut(cluster_tree.build_tree(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    path = f"{tmp_path_factory.mktemp('tree')}/nodes"
    cluster_tree.write_tree(tree, path)
    return tree, path


def test_tree_shape(spark, forest):
    nodes = {r.node_id: r for r in forest[0].collect()}
    assert sum(r.level == 0 for r in nodes.values()) == 1201  # without null, broken and shorter vectors
    below = {}
    for r in nodes.values():
        if r.parent_id:
            below.setdefault(r.parent_id, []).append(r)
    for name, own in below.items():
        parent = nodes[name]
        assert parent.children == len(own) >= cluster_tree.LEAST and parent.leaves == sum(r.leaves for r in own)
        assert list(parent.vector) == [math.floor(sum(v) / len(own)) for v in zip(*(r.vector for r in own), strict=True)]
        assert all(parent.level > r.level for r in own) and parent.level <= cluster_tree.LEVELS
        assert all(parent.angle >= r.angle for r in own)
    assert sum(r.leaves for r in nodes.values() if r.parent_id is None) == 1201


def test_tree_search(spark, forest):
    tree, path = forest
    nodes = [(r.node_id, r.level, np.array(r.vector, dtype=float)) for r in tree.collect()]
    for seed in range(3):
        q = nodes[seed * 97][2] + seed
        cos = lambda v, q=q: round(float(v @ q / (np.linalg.norm(v) * np.linalg.norm(q))), 6) if v.any() else 0.0
        want = sorted(((n, level, cos(v)) for n, level, v in nodes), key=lambda r: (-r[2], r[0]))[:7]
        found = cluster_tree.search_tree(spark, path, q.tolist(), 7, wave=4)
        assert [r[0] for r in found.rows] == [r[0] for r in want]
        assert found.nodes_read < len(nodes) / 2


def test_tree_relatives(spark, forest):
    tree, _ = forest
    leaf = tree.where("level = 0 AND parent_id IS NOT NULL").first()
    up = cluster_tree.ancestors_of(tree, leaf.node_id).orderBy("steps").collect()
    assert up[0].node_id == leaf.parent_id and [r.steps for r in up] == list(range(1, len(up) + 1))
    assert leaf.node_id in {r.node_id for r in cluster_tree.children_of(tree, leaf.parent_id).collect()}


def test_tree_of_nothing(spark):
    none = spark.createDataFrame([(1, None)], "vec_id long, embedding array<double>")
    assert cluster_tree.build_tree(none).collect() == [] and cluster_tree.build_tree(none.limit(0)).collect() == []
    few = spark.createDataFrame([(k, [1.0 * k, 2.0]) for k in range(3)], "vec_id long, embedding array<double>")
    assert {r.parent_id for r in cluster_tree.build_tree(few).collect()} == {None}
    assert cluster_tree.build_tree(few).select(F.countDistinct("node_id")).first()[0] == 3


@pytest.mark.parametrize("seed", [3, 4])
def test_large_components_are_taken_off_whole(spark, monkeypatch, seed):
    """With searches from one node on small graphs too: a large component, tails, others of middle size, and hops by what is new."""
    monkeypatch.setattr(graph, "MANY_EDGES", 10)
    monkeypatch.setattr(graph, "ROUNDS_A_CUT", 2)
    starts = []
    reaches = graph._reaches
    monkeypatch.setattr(graph, "_reaches", lambda edges, start: (starts.append(start.count()), reaches(edges, start))[1])
    pick = random.Random(seed)
    ring = [(k, (k + 1) % 40) for k in range(40)] + [(pick.randint(0, 39), pick.randint(0, 39)) for _ in range(20)]
    tails = [(39, 50), (50, 51), (51, 52), (60, 61), (61, 3), (70, 71), (71, 72), (72, 70), (52, 71)]
    several = [(100 + 10 * c + k, 100 + 10 * c + (k + 1) % 4) for c in range(6) for k in range(4)] + [(100, 110), (130, 7)]
    pairs = ring + tails + several
    to = reach(pairs)
    rows = graph.strong_components(edges_of(spark, pairs)).collect()
    assert {r.node: r.component for r in rows} == {n: min(m for m in to[n] if n in to[m]) for n in to}
    assert starts[0] == 2 and len(starts) > 1  # from one node both ways, then from what is left
