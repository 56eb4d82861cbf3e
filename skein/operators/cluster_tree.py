"""A tree of clusters over embeddings, and the nearest of all its nodes.

Level by level, nodes are put to the nearest of ``n // BRANCH`` centroids, ``MOST`` at most, in integers; clusters of
``LEAST`` members and more become nodes of the next level with the mean of their members, the members of smaller ones
pass up as they are. A level takes a fixed number of jobs, and what is gathered from one is bounded by its centroids.

Components are floor(64 x), clamped to 2**20 in size, so every distance and sum is exact and the tree is the same
wherever it is built. Vectors that are null, hold null or non-finite components or have another length than the first
are left out, of equally near centroids the first counts, rows that share an id are nodes that share one, and an
empty table gives an empty tree.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.vectors import cosine
from skein.operators.graph import cut

SCALE = 64
LARGEST = 1 << 20
BRANCH = 10
MOST = 1024
LEAST = 5
LEVELS = 5
ROUNDS = 1
#: Vectors that are compared with all centroids at once.
CHUNK = 4096
#: Subtrees that a search opens together, and how far scores may be off by rounding.
WAVE = 32
ROUNDING = 1e-6
ROOT = "root"

NODE = "node_id string, level int, vector array<int>, leaves long, children long, angle double"


def leaf_nodes(vectors: DataFrame, dimensions: int) -> DataFrame:
    """Level 0 of ``vectors(vec_id, embedding)``."""
    x = F.col("embedding")
    fine = (F.size(x) == dimensions) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    whole = lambda v: F.floor(F.greatest(F.least(v.cast("double") * SCALE, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))).cast("int")
    zero = F.lit(0).cast("long")
    return vectors.where(fine).select(F.concat(F.lit("0:"), F.col("vec_id").cast("string")).alias("node_id"), F.lit(0).alias("level"), F.transform(x, whole).alias("vector"), F.lit(1).cast("long").alias("leaves"), zero.alias("children"), F.lit(0.0).alias("angle"))


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.float64).reshape(-1, dimensions)


def _nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact, as all sums stay below 2**53; the shared part |x|^2 is left out."""
    half = np.einsum("ij,ij->i", centroids, centroids)
    parts = [(half - 2 * (points[a : a + CHUNK] @ centroids.T)).argmin(axis=1) for a in range(0, len(points), CHUNK)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def _totals(nodes: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, int, list[int]]]:
    """(members, leaves, mean vector) of each centroid that has members: one sum a task and centroid, then one row a component."""
    k, dimensions = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, leaves, total = np.zeros(k, dtype=np.int64), np.zeros(k, dtype=np.int64), np.zeros((k, dimensions), dtype=np.int64)
        for batch in batches:
            points = _matrix(batch["vector"], dimensions)
            cluster = _nearest(points, centroids)
            order = np.argsort(cluster, kind="stable")
            heads = np.flatnonzero(np.diff(cluster[order], prepend=-1))
            if len(heads):
                present = cluster[order][heads]
                total[present] += np.add.reduceat(points[order].astype(np.int64), heads, axis=0)
                members[present] += np.add.reduceat(np.ones(len(order), dtype=np.int64), heads)
                leaves[present] += np.add.reduceat(batch["leaves"].to_numpy()[order], heads)
        at = np.flatnonzero(members)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(members[at]), pa.array(leaves[at]), pa.array(list(total[at]), pa.list_(pa.int64()))], names=["cluster", "members", "leaves", "total"])

    parts = nodes.select("vector", "leaves").mapInArrow(sums, "cluster int, members long, leaves long, total array<long>")
    rows = parts.select("cluster", "members", "leaves", F.posexplode("total").alias("place", "part")).groupBy("cluster", "place").agg(F.sum("members").alias("members"), F.sum("leaves").alias("leaves"), F.sum("part").alias("total"))
    out: dict[int, tuple[int, int, list[int]]] = {}
    for r in rows.collect():
        members, leaves, mean = out.setdefault(r.cluster, (r.members, r.leaves, [0] * dimensions))
        mean[r.place] = r.total // members
    return out


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Angles of rows; a straight one where a vector has no length, so that nothing is ruled out by it."""
    norms = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
    share = np.divide(np.einsum("ij,ij->i", a, b), norms, out=np.full(len(a), -1.0), where=norms > 0)
    return np.arccos(np.clip(share, -1, 1))


def _widest(placed: DataFrame, means: np.ndarray) -> dict[int, float]:
    """For each cluster, an angle to its mean that no node below exceeds."""
    dimensions = means.shape[1]

    def widest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = np.full(len(means), -1.0)
        for batch in batches:
            cluster = batch["cluster"].to_numpy()
            np.maximum.at(most, cluster, _angles(_matrix(batch["vector"], dimensions), means[cluster]) + batch["angle"].to_numpy())
        at = np.flatnonzero(most >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(most[at])], names=["cluster", "angle"])

    rows = placed.select("vector", "angle", "cluster").mapInArrow(widest, "cluster int, angle double").groupBy("cluster").agg(F.max("angle").alias("angle")).collect()
    return {r.cluster: min(math.pi, r.angle + 1e-9) for r in rows}


def build_tree(vectors: DataFrame, *, branch: int = BRANCH, most: int = MOST, least: int = LEAST, levels: int = LEVELS, rounds: int = ROUNDS) -> DataFrame:
    """All nodes of all levels: ``node_id, level, vector, leaves, children, angle, parent_id``.

    ``angle`` bounds how far, in radians, any node below is from the node. Nodes that no cluster takes have no parent.
    """
    spark = vectors.sparkSession
    first = vectors.where("embedding is not null").select(F.size("embedding")).first()
    nodes = cut(leaf_nodes(vectors, first[0] if first else 0))
    done: list[DataFrame] = []
    for level in range(1, levels + 1):
        n = nodes.count()
        k = min(most, max(1, n // branch))
        seeds = nodes.orderBy(F.md5("node_id"), "node_id", "vector").limit(k).select("vector").collect() if n >= least else []
        if not seeds:
            break
        centroids = np.array([r[0] for r in seeds], dtype=np.float64)
        for _ in range(rounds):
            for c, (_, _, mean) in _totals(nodes, centroids).items():
                centroids[c] = mean
        dimensions = centroids.shape[1]

        def place(batches: Iterator[pa.RecordBatch], centroids: np.ndarray = centroids, dimensions: int = dimensions) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.append_column("cluster", pa.array(_nearest(_matrix(batch["vector"], dimensions), centroids), pa.int32()))

        totals = {c: x for c, x in _totals(nodes, centroids).items() if x[0] >= least}
        if not totals:
            break
        placed = cut(nodes.mapInArrow(place, NODE + ", cluster int"))
        kept = F.col("cluster").isin(sorted(totals))
        means = centroids.copy()
        for c, (_, _, mean) in totals.items():
            means[c] = mean
        wide = _widest(placed.where(kept), means)
        done.append(placed.where(kept).withColumn("parent_id", F.concat(F.lit(f"{level}:"), F.col("cluster").cast("string"))).drop("cluster"))
        # one row a centroid
        new = spark.createDataFrame([(f"{level}:{c}", level, mean, leaves, members, wide[c]) for c, (members, leaves, mean) in sorted(totals.items())], NODE)
        nodes = new.unionByName(placed.where(~kept).drop("cluster"))
    out = nodes.withColumn("parent_id", F.lit(None).cast("string"))
    for part in done:
        out = out.unionByName(part)
    return out


def write_tree(tree: DataFrame, path: str, *, rows_a_file: int = 1_000_000) -> None:
    """One folder for the children of each node, so a search reads only those that it opens."""
    family = F.coalesce("parent_id", F.lit(ROOT))
    # a family may hold a large part of all nodes
    spread = F.pmod(F.xxhash64("node_id"), F.lit(max(1, tree.count() // rows_a_file)))
    tree.withColumn("family", family).repartition("family", spread).write.partitionBy("family").parquet(path)


class Found(NamedTuple):
    rows: list[tuple[str, int, float]]  # node, level, score
    nodes_read: int


def search_tree(spark: SparkSession, path: str, query: list[float], k: int, *, wave: int = WAVE) -> Found:
    """The ``k`` nodes of all levels with the highest cosine, best subtrees first.

    A subtree is opened while the cosine that its angle allows reaches the k-th score so far; of what is opened, the
    ``k`` best nodes and the inner nodes come back, which are no more than the centroids of all levels.
    """
    nodes = spark.read.schema(f"{NODE}, parent_id string, family string").parquet(path)
    exact = cosine(F.col("vector"), F.array(*[F.lit(float(x)) for x in query]))
    scored = nodes.select("node_id", "level", "children", "angle", "family", F.coalesce(exact, F.lit(0.0)).alias("exact"))
    scored = scored.withColumn("score", F.round("exact", 6))
    order = [F.desc("score"), F.col("node_id")]
    best: list[tuple[str, int, float]] = []
    heap, sizes, read = [(-2.0, ROOT)], {ROOT: nodes.where(F.col("family") == ROOT).count()}, 0
    while heap:
        least = best[k - 1][2] if len(best) >= k else -2.0
        opened = []
        while heap and len(opened) < wave and -heap[0][0] >= least - ROUNDING:
            opened.append(heapq.heappop(heap)[1])
        if not opened:
            break
        read += sum(sizes[f] for f in opened)
        own = scored.where(F.col("family").isin(opened))
        rows = own.orderBy(*order).limit(k).collect()
        best = sorted({*best, *((r.node_id, r.level, r.score) for r in rows)}, key=lambda r: (-r[2], r[0]))[:k]
        for r in own.where("children > 0").select("node_id", "children", "exact", "angle").collect():
            far = math.acos(min(1.0, max(-1.0, r.exact))) - r.angle
            sizes[r.node_id] = r.children
            heapq.heappush(heap, (-math.cos(max(0.0, far)), r.node_id))
    return Found(best, read)


def children_of(tree: DataFrame, node: str) -> DataFrame:
    return tree.where(F.col("parent_id") == node)


def ancestors_of(tree: DataFrame, node: str, levels: int = LEVELS) -> DataFrame:
    """The node's parent, its parent and so on, nearest first by ``steps``."""
    below = tree.where(F.col("node_id") == node).select(F.col("parent_id").alias("wanted"))
    out = None
    for k in range(1, levels + 1):
        found = tree.join(below, tree.node_id == below.wanted).drop("wanted").dropDuplicates(["node_id"])
        found = found.withColumn("steps", F.lit(k))
        out = found if out is None else out.unionByName(found)
        below = found.select(F.col("parent_id").alias("wanted"))
    return out


def vector_hash(vector: Column) -> Column:
    return F.md5(F.array_join(F.transform(vector, lambda v: v.cast("string")), ","))
