"""Combined search with its switches, forms of a question, embeddings by hash."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from skein.operators import hybrid


def scores(spark, rows):
    return spark.createDataFrame(rows, "path string, score double")


def test_switches(spark):
    vector = scores(spark, [("a", 0.5), ("a", 0.4), ("b", 0.2), (None, 0.9), ("n", None)])
    symbol = scores(spark, [("b", 1.0), ("c", 0.1)])
    edges = spark.createDataFrame([("d", "b"), ("a", "a"), ("c", "a"), ("z", "y"), (None, "b")], "source string, target string")
    run = lambda **o: [(r.path, round(r.score, 6)) for r in hybrid.hybrid(vector, symbol, edges, **o).collect()]
    assert run(use_graph=False) == [("b", 1.1), ("a", 0.5), ("c", 0.09), ("n", 0.0)]
    assert run() == [("b", 1.1), ("a", 0.527), ("d", 0.33), ("c", 0.24), ("n", 0.0)]
    assert run(use_symbol=False, use_graph=False) == [("a", 0.5), ("b", 0.2), ("n", 0.0)]
    assert run(use_vector=False, use_symbol=False) == []
    assert run(k=0) == [("b", 1.1)]
    none = scores(spark, [])
    assert hybrid.hybrid(none, none, edges).collect() == []


def test_forms_of_questions(spark):
    questions = spark.createDataFrame([(7, "why?"), (8, None), (9, "")], "query_id int, text string")
    rows = sorted(map(tuple, hybrid.variants(questions, 2).collect()))
    assert [r[:2] for r in rows] == [(7, 0), (7, 1), (7, 2), (9, 0), (9, 1), (9, 2)]
    assert rows[0][2] == "why?" and all(r[2].startswith("why?\n\n") for r in rows[1:3])
    made = hybrid.variants(questions, 1, generate=lambda q, n: [q.upper()] * n)
    assert sorted(r.text for r in made.where("query_id = 7").collect()) == ["why?", "why?\n\nWHY?"]
    vectors = {(r.query_id, r.variant): np.array(r.embedding) for r in hybrid.embedded(hybrid.variants(questions, 2)).collect()}
    assert all(abs(np.linalg.norm(v) - 1) < 1e-9 and len(v) == hybrid.DIMENSIONS for v in vectors.values())
    assert (vectors[7, 0] == hybrid.hashed_vectors(["why?"])[0]).all()
    assert hybrid.embedded(questions).where("query_id = 8").first().embedding is None


def test_multi_query_finds_texts(spark):
    texts = spark.createDataFrame([(k, f"text {k}") for k in range(60)], "vec_id long, text string")
    vectors = hybrid.embedded(texts).select("vec_id", "embedding")
    questions = spark.createDataFrame([(3, "text 3"), (5, "text 5")], "query_id long, text string")
    forms = hybrid.embedded(hybrid.variants(questions, 2, generate=lambda q, n: ["x"] * n)).select("query_id", "variant", "embedding")
    best = hybrid.multi_query(vectors, forms, 3, each=10)
    assert best.groupBy("query_id").agg(F.count("*").alias("n")).orderBy("query_id").collect() == [(3, 3), (5, 3)]
    only = hybrid.multi_query(vectors, forms.where("variant = 0"), 1)
    assert sorted((r.query_id, r.vec_id) for r in only.collect()) == [(3, 3), (5, 5)]


def test_rerank(spark):
    rows = spark.createDataFrame([(1, 0.9, "a"), (2, 0.8, "long text"), (3, 0.1, "the longest text")], "id int, score double, text string")
    assert [r.id for r in hybrid.rerank(rows, lambda t: F.length(t).cast("double"), first=2).collect()] == [2, 1]
