"""Search by vectors, words and neighbours together, and search with several forms of one question.

Texts become vectors and variants through functions that a user supplies. Those that stand here need no model: an
embedder that draws a vector from a hash of the text, and a generator that puts words around the question.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators import search

#: What each kind of score weighs.
VECTOR, SYMBOL, GRAPH = 1.0, 0.9, 0.3
DIMENSIONS = 384
Embedder = Callable[[list[str]], np.ndarray]
Generator = Callable[[str, int], list[str]]


def hybrid(vector: DataFrame, symbol: DataFrame, edges: DataFrame, *, use_vector: bool = True, use_symbol: bool = True, use_graph: bool = True, k: int | None = None) -> DataFrame:
    """(path, vector, symbol, graph, score): the best ``k``, 20 unless told, of 1 to 100, by weighted scores of the parts that are switched on.

    ``vector`` and ``symbol`` are candidates (path, score), of which a path's best counts. A path that a candidate
    leads to, or that leads to it, over ``edges(source, target)`` gets as its graph score the largest weighted score of such
    candidates. A part that lacks a path, or is switched off, gives 0. Equal scores go by path.
    """
    k, _ = search.bounded(k)
    kinds = [("vector", vector, VECTOR, use_vector), ("symbol", symbol, SYMBOL, use_symbol)]
    zero = F.lit(0.0)
    rows = None
    for name, part, _, on in kinds:
        if on:
            own = part.select("path", *[(F.col("score") if n == name else zero).alias(n) for n, *_ in kinds])
            rows = own if rows is None else rows.unionByName(own)
    if rows is None:
        return vector.limit(0).select("path", zero.alias("vector"), zero.alias("symbol"), zero.alias("graph"), zero.alias("score"))
    found = rows.where("path IS NOT NULL").groupBy("path").agg(*[F.coalesce(F.max(n), zero).alias(n) for n, *_ in kinds])
    own_score = sum((F.col(n) * w for n, _, w, _ in kinds), zero)
    if use_graph:
        found = search.cut(found)
        near = edges.select("source", "target").union(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct().where("source != target")
        given = found.select(F.col("path").alias("source"), own_score.alias("given")).join(near, "source").groupBy(F.col("target").alias("path")).agg(F.max("given").alias("graph"))
        found = found.join(given, "path", "full").select("path", *[F.coalesce(n, zero).alias(n) for n in ("vector", "symbol", "graph")])
    else:
        found = found.withColumn("graph", zero)
    scored = found.withColumn("score", F.round(own_score + F.col("graph") * GRAPH, 6))
    return scored.select("path", "vector", "symbol", "graph", "score").orderBy(F.desc("score"), "path").limit(k)


def hashed_vectors(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """A normal vector of length one for each text, drawn from a hash of it: the same text has the same one everywhere."""
    out = np.empty((len(texts), dimensions))
    for k, text in enumerate(texts):
        seed = int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "little")
        out[k] = np.random.default_rng(seed).standard_normal(dimensions)
    return out / np.linalg.norm(out, axis=1, keepdims=True) if len(texts) else out


def worded(question: str, n: int) -> list[str]:
    """Answers that one might find to a question, as plain patterns."""
    patterns = ["This code answers: {}", "def handler():\n    # {}", "The documentation says about {}", "A test that shows {}", "An error raised by {}"]
    return [patterns[k % len(patterns)].format(question) for k in range(n)]


def variants(questions: DataFrame, n: int, *, generate: Generator = worded) -> DataFrame:
    """(query_id, variant, text): each of ``questions(query_id, text)`` as it is, variant 0, and followed by ``n`` possible answers. Null texts have none."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, k, t) for i, text in zip(batch["query_id"].to_pylist(), batch["text"].to_pylist(), strict=True) if text is not None for k, t in enumerate([text, *(f"{text}\n\n{a}" for a in generate(text, n))])]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], names=["query_id", "variant", "text"])

    return questions.select(F.col("query_id").cast("long").alias("query_id"), "text").mapInArrow(make, "query_id long, variant int, text string")


def embedded(texts: DataFrame, *, embed: Embedder = hashed_vectors, batch: int = 16) -> DataFrame:
    """``texts`` with ``embedding`` of ``text``, made ``batch`` texts at a time; null texts have none."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            found: list[list[float] | None] = [None] * whole.num_rows
            wanted = [(k, t) for k, t in enumerate(whole["text"].to_pylist()) if t is not None]
            for a in range(0, len(wanted), batch):
                for (k, _), v in zip(wanted[a : a + batch], embed([t for _, t in wanted[a : a + batch]]), strict=True):
                    found[k] = v.tolist()
            yield whole.append_column("embedding", pa.array(found, pa.list_(pa.float64())))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields)
    return texts.mapInArrow(make, fields + ", embedding array<double>")


def feedback_variants(vectors: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """(query_id, variant, embedding): each query as it is, and moved half-way to each of the ``n`` other vectors nearest to it."""
    near = search.topk_per_query(vectors, queries, n + 1).where("vec_id != query_id")
    order = F.row_number().over(search.Window.partitionBy("query_id").orderBy("rank"))
    near = near.withColumn("variant", order).where(F.col("variant") <= n)
    other = vectors.select("vec_id", F.col("embedding").alias("other"))
    own = queries.select("query_id", "embedding")
    half = F.zip_with(F.col("embedding").cast("array<double>"), F.col("other").cast("array<double>"), lambda a, b: (a + b) / 2)
    moved = near.join(other, "vec_id").join(own, "query_id").select("query_id", "variant", half.alias("embedding"))
    return own.select("query_id", F.lit(0).alias("variant"), F.col("embedding").cast("array<double>").alias("embedding")).unionByName(moved)


def multi_query(vectors: DataFrame, forms: DataFrame, k: int, *, each: int | None = None, most_forms: int = 64) -> DataFrame:
    """(query_id, vec_id, fused, lists): the ``k`` best of each query, fused by reciprocal ranks over the ``each`` best of all its forms.

    ``forms(query_id, variant, embedding)`` has fewer than ``most_forms`` variants of a query. Equal ones go by id.
    """
    named = forms.select((F.col("query_id") * most_forms + F.col("variant")).alias("query_id"), "embedding")
    hits = search.topk_per_query(vectors, named, each or k)
    query = F.floor(F.col("query_id") / most_forms).cast("long").alias("query_id")
    fused = hits.select(query, "vec_id", "rank").groupBy("query_id", "vec_id").agg(F.round(F.sum(1.0 / (60 + F.col("rank"))), 9).alias("fused"), F.count("*").alias("lists"))
    place = F.row_number().over(search.Window.partitionBy("query_id").orderBy(F.desc("fused"), "vec_id"))
    return fused.withColumn("rank", place).where(F.col("rank") <= k)


def rerank(candidates: DataFrame, score: Callable[[Column], Column], *, first: int, top: int = 20) -> DataFrame:
    """Candidates (id, score, text) ordered again by a score of their text, as a cross-encoder would give it."""
    return search.reranked(candidates, score(F.col("text")), first=first, top=top)
