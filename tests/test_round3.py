"""Plans and results that large tables need, on small ones."""

from __future__ import annotations

import itertools
import tracemalloc

import numpy as np
import pytest

from skein.operators import graph, research, search, symbols
from skein.plans.every_query import QUERIES
from skein.sources import code_view
from skein.streaming import alerts


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["import_edges", "expanded_candidates", "resolved_references", "call_graph", "call_order", "graph_answer", "fuzzy_symbols", "context_lines"])
def test_no_rows_made_from_files_are_broadcast(spark, sf_dir, name):
    """Small files say nothing of what is made from them; the evidence of an answer is bounded by k."""
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert ("BroadcastHashJoin" not in plan) or name == "graph_answer"


@pytest.mark.parametrize("name", ["pagerank", "reached", "reached_by"])
def test_graphs_join_by_merging(spark, name):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), (None, "a")], "source string, target string")
    seeds = spark.createDataFrame([("a",)], "node string")
    joins = []
    cut, graph.cut = graph.cut, lambda df: (joins.append(plan_of(df)), cut(df))[1]
    try:
        graph.pagerank(edges, 2) if name == "pagerank" else getattr(graph, name)(edges, seeds, 2)
    finally:
        graph.cut = cut
    assert joins and not any("BroadcastHashJoin" in p for p in joins)


def test_files_are_dealt_before_they_are_split(spark, sf_dir):
    """One group of rows is read by one task; neither texts nor their lines are made there."""
    plan = plan_of(symbols.extract_symbols(symbols.line_table(code_view.part_code(spark, sf_dir))))
    above, below = plan.split("Exchange", 1)
    assert "split(" in above and "split(" not in below and "import {" not in below


def test_configurations_are_dealt_before_they_are_parsed(spark, sf_dir):
    for name in ("parsed_loadouts", "validated_loadouts"):
        assert "FileScan" not in plan_of(QUERIES[name](spark, sf_dir))


def test_calls_are_dealt_by_path_once(spark):
    text = "def a():\n  b()\ndef b():\n  a(); c()\ndef a():\n  c(); a(); b()\ndef d():\n  pass"
    files = spark.createDataFrame([("x.py", text), ("y.py", None)], "path string, content string")
    calls = symbols.call_edges(symbols.line_table(files))
    assert plan_of(calls).count("Exchange") == 1
    found = sorted(map(tuple, calls.collect()), key=str)
    assert found == [("x.py", "a", "b", 5, 2), ("x.py", "a", "c", 5, 1), ("x.py", "b", "a", 3, 1), ("x.py", "b", "c", 3, 2), ("x.py", "d", None, None, None)]


def test_downtime_is_the_same_in_any_order(spark):
    """A mean of six is not above six, whatever the order of additions."""
    rows = [(i, "x", s) for i, order in enumerate(itertools.permutations(MEAN_OF_SIX)) for s in order]
    risks = spark.createDataFrame(rows, "run int, category string, score double").coalesce(1)
    assert {r[0] for r in research.risk_figures(risks, "run").select("downtime_hours").distinct().collect()} == {2}


MEAN_OF_SIX = [6.4, 9.8, 1.8]


class _Map:
    """A map state in memory that counts what is read of it at once."""

    def __init__(self):
        self.values, self.most = {}, 0

    def exists(self):
        return bool(self.values)

    def keys(self):
        return iter(list(self.values))

    def getValue(self, key):
        return self.values[key]

    def updateValue(self, key, value):
        self.values[key] = value

    def removeKey(self, key):
        del self.values[key]


def test_a_slot_of_a_key_is_read_at_a_time():
    """The rows of a key reach ``step`` in order and slot by slot, and what is not due stays."""
    seen = []

    class Noting(alerts.InOrder):
        def step(self, memo, rows, until):
            seen.append(([at for at, _ in rows], until))
            yield from ((at,) for at, _ in rows)

    made, memo, left = Noting(["label", "at"]), {}, []
    made.waiting = _Map()
    times = [3 * alerts.SLOT + 5, 7, 3 * alerts.SLOT + 1, 1, alerts.SLOT, alerts.SLOT - 1]
    made._put(memo, [(at, "{}") for at in times])
    out = [at for (at,) in made._take(memo, 3 * alerts.SLOT + 2, left)]
    assert out == sorted(times)[:-1] and left == [3 * alerts.SLOT + 5]
    assert [rows for rows, _ in seen] == [[1, 7, alerts.SLOT - 1], [alerts.SLOT], [3 * alerts.SLOT + 1], []]
    assert len(made.waiting.values) == 1


def test_scores_of_a_block_are_held_for_some_queries_at_a_time():
    """A whole block of queries has 32 MB of scores, and several copies of them."""
    rng = np.random.default_rng(1)
    matrix = rng.normal(size=(search.BLOCK_ROWS, 8))
    asked, ids = matrix[: search.QUERY_ROWS], np.arange(search.BLOCK_ROWS)
    tracemalloc.start()
    found = [np.concatenate(x) for x in zip(*search._nearest(ids[: len(asked)], asked, ids, matrix, 3), strict=True)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20
    score = np.round(asked @ matrix.T, 6)
    for q in (0, 127, 128, 1023):
        assert found[1][found[0] == q].tolist() == np.lexsort((ids, -score[q]))[:3].tolist()
