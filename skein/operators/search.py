"""Vector, symbol and hybrid retrieval.

Defined results: equal scores go by the smaller id or path; null vectors and those without length have no score and come
last where one is asked for, or not at all in blocks; repeated ids are hits of their own; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.vectors import cosine
from skein.operators.graph import cut


def vector_scores(vectors: DataFrame, query: list[float]) -> DataFrame:
    """All vectors with their cosine to one query, which travels as a literal."""
    return vectors.withColumn("score", F.round(cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query])), 6))


def vector_topk(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """The ``k`` nearest; each task keeps its own ``k`` before they meet."""
    return vector_scores(vectors, query).orderBy(F.desc("score"), "vec_id").limit(k)


#: Rows of a block of vectors and of a block of queries that are multiplied with one another.
BLOCK_ROWS, QUERY_ROWS = 4096, 1024
#: Queries of a block whose scores are held at once.
SCORED_ROWS = 128


def _blocks(vectors: DataFrame, name: str, rows: int) -> DataFrame:
    """Rows of up to ``rows`` ids and vectors of length one, as packed arrays; vectors of no length become zeros."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = batch["embedding"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            norm = np.linalg.norm(matrix, axis=1, keepdims=True)
            matrix = np.divide(matrix, norm, out=np.zeros_like(matrix), where=norm > 0)
            for a in range(0, batch.num_rows, rows):
                ids, part = batch["id"].slice(a, rows), matrix[a : a + rows]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([part.tobytes()], pa.binary())], names=[f"{name}_ids", f"{name}_packed"])

    return vectors.select(F.col("id").cast("long").alias("id"), "embedding").mapInArrow(packed, f"{name}_ids array<long>, {name}_packed binary")


def _nearest(query: np.ndarray, asked: np.ndarray, vec: np.ndarray, matrix: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, vector ids, scores): the ``k`` best of a block for each query, some queries at a time."""
    for a in range(0, len(query), SCORED_ROWS):
        own = query[a : a + SCORED_ROWS]
        score = np.round(asked[a : a + SCORED_ROWS] @ matrix.T, 6)
        # what reaches a query's k-th score, ties of it too, is ordered
        least = np.partition(score, -k, axis=1)[:, -k] if k < len(vec) else np.full(len(own), -np.inf)
        q, v = np.nonzero(score >= least[:, None])
        order = np.lexsort((vec[v], -score[q, v], q))
        q, v = q[order], v[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        q, v = q[place < k], v[place < k]
        yield own[q], vec[v], score[q, v]


def topk_per_query(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, rank): a stated query set against all rows, block by block.

    Blocks are multiplied as matrices and leave the ``k`` best of each query; ``k`` for each block of vectors and
    query then meet. All vectors have the same length; null vectors are left out.
    """
    left = _blocks(vectors.where("embedding is not null").withColumnRenamed("vec_id", "id"), "vec", BLOCK_ROWS)
    right = _blocks(queries.where("embedding is not null").withColumnRenamed("query_id", "id"), "query", QUERY_ROWS)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                vec, query = (batch[c][row].values.to_numpy() for c in ("vec_ids", "query_ids"))
                asked = np.frombuffer(batch["query_packed"][row].as_buffer()).reshape(len(query), -1)
                matrix = np.frombuffer(batch["vec_packed"][row].as_buffer()).reshape(len(vec), -1)
                for found in _nearest(query, asked, vec, matrix, k):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query_id", "vec_id", "score"])

    near = left.crossJoin(right).mapInArrow(best, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked_lists(scored: DataFrame) -> DataFrame:
    """``scored(list, id, score)`` with ``rank`` from 1, the largest score of each list first, then the smallest id.

    Rows are dealt by ranges of list, score and id and counted there, and what earlier ranges hold of a list is added,
    so a list may be as long as all others together.
    """
    order = ["list", F.desc("score"), "id"]
    dealt = cut(scored.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    local = F.row_number().over(Window.partitionBy("part", "list").orderBy(F.desc("score"), "id"))
    counts = dealt.groupBy("part", "list").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("list").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = dealt.withColumn("local", local).join(counts.select("part", "list", before.alias("before")), ["part", "list"])
    return joined.select("list", "id", "score", (F.col("before") + F.col("local")).cast("int").alias("rank"))


def reciprocal_rank_fusion(lists: DataFrame, k: int = 60) -> DataFrame:
    """``lists(list, id, rank)`` to (id, fused)."""
    return lists.groupBy("id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("fused"), F.count("*").alias("lists"))


def weighted_fusion(lists: DataFrame, weights: dict[str, float]) -> DataFrame:
    weight = F.coalesce(*[F.when(F.col("list") == n, F.lit(w)) for n, w in weights.items()], F.lit(0.0))
    return lists.groupBy("id").agg(F.round(F.sum(weight * F.col("score")), 6).alias("fused"))


def union_of_candidates(*parts: DataFrame) -> DataFrame:
    """Candidates (path, start, end, score) of all sources; of one span the best score."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("path", "start", "end").agg(F.max("score").alias("score"))


def score_histogram(scores: DataFrame, buckets: int, score: Column | None = None) -> DataFrame:
    bucket = F.width_bucket(score if score is not None else F.col("score"), F.lit(-1.0), F.lit(1.0), F.lit(buckets))
    return scores.groupBy(bucket.cast("long").alias("bucket")).agg(F.count("*").alias("n"))


def as_results(candidates: DataFrame, repo_root: str) -> DataFrame:
    """Candidates ``path, start, end, score, content, rev, hash`` as results with their citation; what is missing gets its default."""
    span = F.struct(F.coalesce("start", F.lit(0)).alias("start"), F.coalesce("end", F.lit(0)).alias("end"))
    citation = F.struct(
        F.lit(repo_root).alias("repo_root"), F.coalesce("rev", F.lit("main")).alias("rev"), F.col("path"), span.alias("span"), F.coalesce("hash", F.lit("")).alias("content_sha")
    )
    return candidates.select("path", span.alias("span"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("content", F.lit("")).alias("content"), citation.alias("citation"))


def filtered(candidates: DataFrame, *, least: float = 0.3, **equal: str | None) -> DataFrame:
    """Candidates with a score of ``least`` or more and the stated values, where any are stated."""
    out = candidates.where(F.col("score") >= least)
    for column, value in equal.items():
        out = out if value is None else out.where(F.col(column) == value)
    return out


def merged_indexes(hits: DataFrame, index: str, *, each: int = 5, top: int = 10) -> DataFrame:
    """The ``top`` of the ``each`` best hits ``(<index>, id, score)`` of every index."""
    best = Window.partitionBy(index).orderBy(F.desc("score"), "id")
    kept = hits.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= each).drop("_rank")
    return kept.orderBy(F.desc("score"), "id", index).limit(top)


def reranked(candidates: DataFrame, score: Column, *, first: int, top: int = 20) -> DataFrame:
    """The ``first`` candidates by their own score, ordered again by ``score``; ``top`` of them stay."""
    return candidates.orderBy(F.desc("score"), "id").limit(first).withColumn("score", score).orderBy(F.desc("score"), "id").limit(top)


def expanded(candidates: DataFrame, edges: DataFrame, damping: float = 0.3) -> DataFrame:
    """Candidates ``(path, score)`` and the files that they lead to by ``edges(source, target)``, with a share of the score; the best of each."""
    near = candidates.join(edges.select("source", "target").distinct().hint("merge"), F.col("path") == F.col("source")).select(F.col("target").alias("path"), (F.col("score") * damping).alias("score"))
    return candidates.select("path", "score").unionByName(near).groupBy("path").agg(F.max("score").alias("score"))


def snippets(hits: DataFrame) -> DataFrame:
    """One hit of each (path, start, end), the best one and of equals the first by ``id``, ranked within its file."""
    best = hits.groupBy("path", "start", "end").agg(F.max_by(F.struct("id", "score"), F.struct("score", -F.col("id"))).alias("b")).select("path", "start", "end", "b.id", "b.score")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("score"), "start", "end")))


def span_context(files: DataFrame, spans: DataFrame, context: int) -> DataFrame:
    """(path, start, end, text, before, after): characters ``start`` to ``end`` of each file, with so many on either side."""
    joined = spans.join(files.hint("merge"), "path")
    low = F.greatest(F.col("start") - context, F.lit(0))
    part = lambda a, b: F.substring("content", a + 1, F.greatest(b - a, F.lit(0)))
    return joined.select("path", "start", "end", part(F.col("start"), F.col("end")).alias("text"), part(low, F.col("start")).alias("before"), part(F.col("end"), F.col("end") + context).alias("after"))


def bounded(k: int | None = None, context_lines: int | None = None) -> tuple[int, int]:
    """Arguments of a search within their bounds: 1 to 100 results, 0 to 20 lines."""
    return min(100, max(1, 20 if k is None else k)), min(20, max(0, 5 if context_lines is None else context_lines))
