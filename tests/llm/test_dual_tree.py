"""Dual-tree clustering against plain rounds over all pairs."""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from skein.llm import dual_tree
from skein.llm.queries import QUERIES


def plain(rows, k=16, rounds=3, scale=64, dimensions=64):
    """(vec_id, cluster, distance, cluster inertia, inertia, hash) of every usable row, sorted."""
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda r: (hashlib.sha256(f"1:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=name)[:k]]
    x = np.array([v for _, v in kept], dtype=np.int64).reshape(-1, dimensions)

    def assign():
        far = ((x[:, None, :] - np.array(centroids, dtype=np.int64)[None]) ** 2).sum(axis=2)
        return far.argmin(axis=1), far.min(axis=1)

    for _ in range(rounds if kept else 0):
        cluster, _ = assign()
        centroids = [[int(s) // int((cluster == c).sum()) for s in x[cluster == c].sum(axis=0)] if (cluster == c).any() else centroids[c] for c in range(len(centroids))]
    if not kept:
        return []
    cluster, far = assign()
    inertia = defaultdict(int)
    for c, d in zip(cluster.tolist(), far.tolist(), strict=True):
        inertia[c] += d
    key = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), key[c]) for (i, _), c, d in zip(kept, cluster.tolist(), far.tolist(), strict=True)), key=str)


def run(spark, path):
    got = QUERIES["op13_dual_tree_lloyd"](spark, path)
    return sorted(map(tuple, got.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


def test_op13(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert run(spark, sf_dir) == plain(rows)


@pytest.fixture
def table(spark, tmp_path):
    def write(rows):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster string, label int")
        df.write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
        return str(tmp_path)

    return write


def test_odd_vectors(spark, table):
    """Nulls, other lengths, non-finite and large components, ties, copies and shared ids."""
    pick = np.random.default_rng(5)
    centres = pick.normal(0, 5, (9, 64)).astype(np.float32)
    rows = [(i, (centres[i % 9] + pick.normal(0, 0.05, 64)).astype(np.float32).tolist(), "clash", 1) for i in range(1500)]
    rows += [(5000 + i, centres[0].tolist(), None, None) for i in range(700)]
    rows += [(6000, None, "", 0), (6001, [], "", 0), (6002, [1.0] * 63, "", 0), (6003, [1.0] * 63 + [None], "", 0), (6004, [float("nan")] * 64, "", 0), (6005, [float("-inf")] * 64, "", 0)]
    rows += [(None, [0.0] * 64, "", 0), (7000, [-0.001] * 64, "", 0), (7000, [0.5] * 64, "", 0), (7000, [0.5] * 64, "", 0), (8000, [60000.0] * 64, "", 0)]
    want = plain([r[:2] for r in rows])
    assert len(want) == 1500 + 700 + 5
    assert run(spark, table(rows)) == want


def test_few_equal_and_no_vectors(spark, table):
    same = [(i, [0.25] * 64, "", 0) for i in range(40)]
    assert run(spark, table(same)) == plain([r[:2] for r in same])
    three = [(i, [float(i)] * 64, "", 0) for i in range(3)]
    assert run(spark, table(three)) == plain([r[:2] for r in three])
    assert run(spark, table([])) == []


def test_components_out_of_range(spark, table):
    got = run(spark, table([(1, [1e30] + [0.0] * 63, "", 0), (2, [-1e30] + [0.0] * 63, "", 0), (3, [0.0] * 64, "", 0)]))
    assert [r[2] for r in got] == [0, 0, 0]


@pytest.mark.parametrize("seed", range(6))
def test_trees_prune_and_agree(seed):
    pick = np.random.default_rng(seed)
    n, d, k = 900, int(pick.integers(1, 20)), int(pick.integers(1, 60))
    centres = pick.integers(-2000, 2000, (12, d))
    points = centres[pick.integers(0, 12, n)] + pick.integers(-20, 21, (n, d))
    if seed % 2:
        points = pick.integers(-3, 4, (n, d))  # many ties and copies
    centroids = points[pick.integers(0, n, k)]
    order, tree = dual_tree.cover_tree(points)
    points = points[order]
    # every node covers its points; children divide them, lie within half the radius and are farther apart than that
    for lo, hi, child, many, radius in zip(*tree, strict=True):
        assert (dual_tree.squared(points[lo:hi], points[lo : lo + 1]) <= radius * radius * (1 + 1e-12)).all()
        assert not many or (tree.low[child] == lo and tree.high[child + many - 1] == hi and (tree.low[child + 1 : child + many] == tree.high[child : child + many - 1]).all())
        if many:
            heads = points[tree.low[child : child + many]]
            apart = np.sqrt(((heads[:, None, :] - heads[None]) ** 2).sum(axis=2)) + np.diag([np.inf] * many)
            assert apart.min() > tree.radius[child : child + many].max() and tree.radius[child : child + many].max() <= radius / 2 * (1 + 1e-6)
    cluster, compared = dual_tree.nearest(points, tree, centroids)
    far = ((points[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert (cluster == far.argmin(axis=1)).all()
    assert seed % 2 or compared < n * k / 2
