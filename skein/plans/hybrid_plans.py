"""Registered queries of combined and of multiple searches, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions.text import relevance
from skein.operators import hybrid, search
from skein.plans.queries import _COS, _WORDS_SQL, QUESTION, TOP, _first_vector, _table, query

_PARTS_SQL = f"""WITH n AS (SELECT max(doc_id) + 1 AS n FROM documents),
v AS (SELECT 'd' || e.vec_id AS path, {_COS} AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY score DESC, e.vec_id LIMIT {3 * TOP}),
w AS (SELECT 'd' || doc_id AS path, round(least({_WORDS_SQL}, 1.0), 6) AS score FROM documents),
s AS (SELECT path, score FROM w WHERE score > 0),
e AS (SELECT 'd' || doc_id AS source, 'd' || (n_chars * 7 + doc_id) % n AS target FROM documents, n)"""


def _parts(spark, sf_dir):
    vectors, docs = _table(spark, sf_dir, "embeddings"), _table(spark, sf_dir, "documents")
    path = lambda c: F.concat(F.lit("d"), c)
    near = search.vector_topk(vectors, _first_vector(vectors), 3 * TOP).select(path("vec_id").alias("path"), "score")
    words = docs.select(path("doc_id").alias("path"), F.round(relevance(F.col("text"), F.lit("doc.txt"), QUESTION), 6).alias("score")).where("score > 0")
    n = docs.agg(F.max("doc_id") + 1).first()[0] or 1
    edges = docs.select(path("doc_id").alias("source"), path((F.col("n_chars") * 7 + F.col("doc_id")) % n).alias("target"))
    return near, words, edges


@query(
    f"""{_PARTS_SQL}, f AS (SELECT path, max(v) AS vector, max(s) AS symbol FROM (SELECT path, score AS v, 0.0::DOUBLE AS s FROM v UNION ALL SELECT path, 0.0::DOUBLE, score FROM s) GROUP BY path),
o AS (SELECT *, vector + symbol * 0.9::DOUBLE AS own FROM f),
b AS (SELECT source, target FROM e WHERE source <> target UNION SELECT target, source FROM e WHERE source <> target),
g AS (SELECT target AS path, max(own) AS graph FROM o JOIN b ON o.path = b.source GROUP BY target),
a AS (SELECT path, coalesce(vector, 0) AS vector, coalesce(symbol, 0) AS symbol, coalesce(graph, 0) AS graph FROM f FULL JOIN g USING (path))
SELECT path, round(vector, 6) AS vector, round(symbol, 6) AS symbol, round(graph, 6) AS graph, round(vector + symbol * 0.9::DOUBLE + graph * 0.3::DOUBLE, 6) AS score FROM a ORDER BY score DESC, path LIMIT {5 * TOP}"""
)
def hybrid_parts(spark, sf_dir):
    """Vectors, words and neighbours of both weighed together."""
    out = hybrid.hybrid(*_parts(spark, sf_dir), k=5 * TOP)
    return out.select("path", *[F.round(c, 6).alias(c) for c in ("vector", "symbol", "graph")], "score")


@query(f"{_PARTS_SQL} SELECT path, 0.0::DOUBLE AS vector, round(score, 6) AS symbol, 0.0::DOUBLE AS graph, round(score * 0.9::DOUBLE, 6) AS score FROM s ORDER BY 5 DESC, path LIMIT {TOP}")
def hybrid_words_only(spark, sf_dir):
    """The same search with vectors and neighbours switched off."""
    return hybrid.hybrid(*_parts(spark, sf_dir), use_vector=False, use_graph=False, k=TOP)


_FORMS = 3
_SIM = "round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding), 6)"


@query(
    f"""WITH o AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS embedding FROM embeddings WHERE vec_id % 20 = 0),
t AS (SELECT q.query_id, e.vec_id, row_number() OVER (PARTITION BY q.query_id ORDER BY {_SIM} DESC, e.vec_id) AS rank FROM embeddings e, o q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS variant FROM t WHERE rank <= {_FORMS + 1} AND vec_id <> query_id),
f AS (SELECT query_id, 0 AS variant, embedding FROM o
  UNION ALL SELECT r.query_id, r.variant, list_transform(list_zip(q.embedding, e.embedding::DOUBLE[]), lambda p: (p[1] + p[2]) / 2) FROM r JOIN o q ON r.query_id = q.query_id JOIN embeddings e ON e.vec_id = r.vec_id WHERE r.variant <= {_FORMS}),
h AS (SELECT query_id, vec_id, rank FROM (SELECT q.query_id, e.vec_id, row_number() OVER (PARTITION BY q.query_id, q.variant ORDER BY {_SIM} DESC, e.vec_id) AS rank FROM embeddings e, f q) WHERE rank <= {TOP}),
g AS (SELECT query_id, vec_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS fused, count(*) AS lists FROM h GROUP BY 1, 2)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, vec_id) AS INTEGER) AS rank FROM g) WHERE rank <= {TOP}"""
)
def multi_query_search(spark, sf_dir):
    """A stated set of queries, each in four forms: as it is, and moved half-way to its three nearest vectors."""
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    queries = vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    return hybrid.multi_query(vectors, hybrid.feedback_variants(vectors, queries, _FORMS), TOP)
