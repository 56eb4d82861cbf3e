"""Lloyd's clustering with two trees: a cover tree over vectors and one over centroids.

Vectors are cut into blocks of ``BLOCK`` rows as they come, and each block becomes a cover tree once: a node
holds the vectors within its radius of one of them, its children are nets of half that radius, the first one
around the node's own centre. A single tree over all vectors would have to stand in one task; a forest gives the
same assignment, because every vector is compared with all centroids that its own tree cannot rule out. Blocks
are rows of a table in the shared folder, so a lost executor costs the blocks it was reading.

Each round builds a tree over the centroids in every task and walks pairs of nodes. A pair goes when its
lower distance bound is above the upper bound of the vectors' node; where one centroid is left, the whole node is
assigned without looking at its vectors; pairs of leaves are compared exactly in integers. Tasks send one sum a
centroid, so a round gathers ``k`` times the dimensions, however many vectors there are.

Defined results: vectors of another length, null ones and those with null or non-finite components are left out;
components are clamped to 2**26 in size, beyond which squared distances would leave 64 bits; ties go to the smaller
centroid number; equal vectors may start as several centroids, of which all but the first stay empty; with fewer
vectors than ``k`` each starts one; rows that share a ``vec_id`` are clustered each by its own vector (as starts they
come by vector), and a null ``vec_id`` is hashed as the word null; sums beyond 64 bits are null; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.storage import Scope

K = 16
ROUNDS = 3
DIMENSIONS = 64
SCALE = 64
LARGEST = 1 << 26
BLOCK = 1024
#: Vectors of a node that is not split further.
LEAF = 8
#: Bounds are widened by this share and this amount, far more than square roots of exact integers are off.
SLACK = 1e-9

BLOCKS = "vec_ids array<long>, points array<int>, low array<int>, high array<int>, child array<int>, children array<int>, radius array<double>"
ASSIGNED = "vec_id long, cluster int, distance long"


class Tree(NamedTuple):
    """Nodes in breadth-first order over points in tree order; a node's centre is the first of its points."""

    low: np.ndarray  # first point
    high: np.ndarray  # point after the last
    child: np.ndarray  # first child
    children: np.ndarray  # how many; none in a leaf
    radius: np.ndarray


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    gap = a - b
    return np.einsum("ij,ij->i", gap, gap)


def _net(gaps: np.ndarray, reach: float) -> tuple[np.ndarray, list[int]]:
    """(which net point covers each point, the net points): more than ``reach`` apart, each next one the farthest uncovered point."""
    owner = np.where(gaps[0] <= reach, 0, -1)
    nearest, centres = gaps[0].copy(), [0]
    while (owner < 0).any():
        new = int(np.argmax(np.where(owner < 0, nearest, -1.0)))
        owner[(owner < 0) & (gaps[new] <= reach)] = len(centres)
        owner[new] = len(centres)
        centres.append(new)
        nearest = np.minimum(nearest, gaps[new])
    return owner, centres


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, Tree]:
    """(order of the points, tree over the points in that order). Nets are found on rounded distances, radii are exact."""
    n = len(points)
    real = points.astype(np.float64)
    norms = np.einsum("ij,ij->i", real, real)
    gaps = np.sqrt(np.maximum(norms[:, None] + norms[None, :] - 2 * (real @ real.T), 0))
    order, low, high, child, children, radius = np.arange(n), [0], [n], [], [], []
    at = 0
    while at < len(low):
        lo, hi = low[at], high[at]
        own = order[lo:hi]
        far = math.sqrt(int(squared(points[own], points[own[:1]]).max()))
        radius.append(far)
        child.append(len(low))
        children.append(0)
        at += 1
        if far == 0 or hi - lo <= leaf:
            continue
        within, reach = gaps[np.ix_(own, own)], far / 2
        owner, centres = _net(within, reach)
        while len(centres) < 2 and reach > far * SLACK:
            reach /= 2
            owner, centres = _net(within, reach)
        if len(centres) < 2:
            continue
        sizes = np.bincount(owner)
        first = np.ones(len(own), dtype=np.int64)
        first[centres] = 0
        order[lo:hi] = own[np.lexsort((first, owner))]
        children[-1] = len(sizes)
        bounds = lo + np.append(0, np.cumsum(sizes))
        low.extend(bounds[:-1].tolist())
        high.extend(bounds[1:].tolist())
    whole = [np.array(x, dtype=np.int64) for x in (low, high, child, children)]
    return order, Tree(*whole, np.array(radius))


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... count[0] of them, then those of the next."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - count), count)


def nearest(points: np.ndarray, tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """(nearest centroid of every point, how many distances of points and centroids were needed)."""
    order, other = cover_tree(centroids, leaf=1)
    placed = centroids[order]
    # a leaf holds one centroid, or equal ones, of which the smallest number wins
    number = np.array([order[a:b].min() for a, b in zip(other.low, other.high, strict=True)])
    out, compared = np.zeros(len(points), dtype=np.int64), 0
    q, r = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    while len(q):
        gap = np.sqrt(squared(points[tree.low[q]], placed[other.low[r]]).astype(np.float64))
        lower = (gap - tree.radius[q] - other.radius[r]) * (1 - SLACK) - SLACK * (1 + gap)
        upper = (gap + tree.radius[q]) * (1 + SLACK) + SLACK
        heads = np.flatnonzero(np.diff(q, prepend=-1))
        kept = lower <= np.repeat(np.minimum.reduceat(upper, heads), np.diff(np.append(heads, len(q))))
        q, r = q[kept], r[kept]
        heads = np.flatnonzero(np.diff(q, prepend=-1))
        sizes = np.diff(np.append(heads, len(q)))
        inner_r, inner_q = other.children[r] > 0, tree.children[q] > 0

        single = np.repeat(sizes == 1, sizes) & ~inner_r
        out[_ranges(tree.low[q[single]], (tree.high - tree.low)[q[single]])] = np.repeat(number[r[single]], (tree.high - tree.low)[q[single]])

        split_r = inner_r & (~inner_q | (other.radius[r] >= tree.radius[q]))
        group_r = np.repeat(np.logical_or.reduceat(split_r, heads), sizes)
        split_q = ~single & ~group_r & inner_q
        # where only leaves are left on both sides, compare; an inner centroid node is split first
        exact = ~single & ~group_r & ~inner_q
        if exact.any():
            eq, er = q[exact], number[r[exact]]
            count = (tree.high - tree.low)[eq]
            point, centroid = _ranges(tree.low[eq], count), np.repeat(er, count)
            far = squared(points[point], centroids[centroid])
            best = np.lexsort((centroid, far, point))
            one = np.flatnonzero(np.diff(point[best], prepend=-1))
            out[point[best][one]] = centroid[best][one]
            compared += len(point)
        wait = ~single & group_r & ~split_r
        parts = [
            (q[wait], r[wait]),
            (np.repeat(q[split_r], other.children[r[split_r]]), _ranges(other.child[r[split_r]], other.children[r[split_r]])),
            (_ranges(tree.child[q[split_q]], tree.children[q[split_q]]), np.repeat(r[split_q], tree.children[q[split_q]])),
        ]
        q, r = np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])
        by_q = np.argsort(q, kind="stable")
        q, r = q[by_q], r[by_q]
    return out, compared


def usable(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """``vec_id, point``: vectors of the length, all components finite, as integers floor(scale * x)."""
    x = F.col("embedding")
    fine = (F.size(x) == dimensions) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    held = lambda v: F.greatest(F.least(v.cast("double") * scale, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))
    return vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(held(v)).cast("int")).alias("point"))


def first_centroids(points: DataFrame, k: int = K) -> list[list[int]]:
    """Points with the smallest hashes of their ids: ``k`` rows."""
    name = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    return [list(r[0]) for r in points.select("point", name.alias("name")).orderBy("name", "point").limit(k).select("point").collect()]


def forest(points: DataFrame, dimensions: int, block: int = BLOCK) -> DataFrame:
    """One row for each block of points: a cover tree and the points in its order."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch["point"].flatten().to_numpy().astype(np.int64).reshape(-1, dimensions)
            for a in range(0, batch.num_rows, block):
                own = values[a : a + block]
                order, tree = cover_tree(own)
                ids = batch["vec_id"].slice(a, len(own)).take(pa.array(order))
                lists = [ids, pa.array(own[order].ravel(), pa.int32()), *(pa.array(x, pa.int32()) for x in tree[:4]), pa.array(tree.radius)]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists], names=["vec_ids", "points", *Tree._fields])

    return points.mapInArrow(build, BLOCKS)


def _trees(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[tuple[pa.Array, np.ndarray, Tree]]:
    for batch in batches:
        for k in range(batch.num_rows):
            at = lambda name, k=k, batch=batch: batch[name][k].values
            points = at("points").to_numpy().astype(np.int64).reshape(-1, dimensions)
            yield at("vec_ids"), points, Tree(*(at(f).to_numpy().astype(np.int64) for f in Tree._fields[:4]), at("radius").to_numpy())


def moved(blocks: DataFrame, centroids: list[list[int]], dimensions: int) -> list[list[int]]:
    """Centroids after one round: componentwise floor of the mean; an empty one stays. Gathers k times the dimensions."""
    now = np.array(centroids, dtype=np.int64)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(now), dtype=np.int64), np.zeros_like(now)
        for _, points, tree in _trees(batches, dimensions):
            cluster, _ = nearest(points, tree, now)
            count += np.bincount(cluster, minlength=len(now))
            for c in np.unique(cluster):
                total[c] += points[cluster == c].sum(axis=0)
        for c in np.flatnonzero(count):
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([count[c]]), pa.array([total[c]], pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    parts = blocks.mapInArrow(sums, "cluster int, n long, total array<long>")
    rows = parts.select("cluster", "n", F.posexplode("total").alias("place", "part")).groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("part").alias("total")).collect()
    out = [list(c) for c in centroids]
    for row in rows:
        out[row.cluster][row.place] = row.total // row.n
    return out


def assigned(blocks: DataFrame, centroids: list[list[int]], dimensions: int) -> DataFrame:
    now = np.array(centroids, dtype=np.int64)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, points, tree in _trees(batches, dimensions):
            cluster, _ = nearest(points, tree, now)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(squared(points, now[cluster]))], names=["vec_id", "cluster", "distance"])

    return blocks.mapInArrow(assign, ASSIGNED)


def cluster(vectors: DataFrame, *, k: int = K, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, block: int = BLOCK) -> tuple[DataFrame, list[list[int]]]:
    """(``vec_id, cluster, distance`` of every usable vector, the final centroids)."""
    spark = vectors.sparkSession
    scope, points = Scope(spark), usable(vectors, dimensions, scale)
    centroids = first_centroids(points, k)
    if not centroids:
        return spark.createDataFrame([], ASSIGNED), []
    blocks = scope.saved(forest(points, dimensions, block), "cover-trees")
    for _ in range(rounds):
        centroids = moved(blocks, centroids, dimensions)
    out = scope.saved(assigned(blocks, centroids, dimensions), "assigned")
    scope.drop("cover-trees")
    return out, centroids


def op13_dual_tree_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    of = {r.cluster: r.own for r in rows.groupBy("cluster").agg(F.expr("try_sum(distance)").alias("own")).collect()}
    whole = None if None in of.values() or sum(of.values()) >= 1 << 63 else sum(of.values())
    told = [(c, of.get(c), whole, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids)]
    about = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # one row a centroid
    return rows.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
