"""Registered queries over trees of clusters, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skein.operators import cluster_tree as tree
from skein.plans.queries import TOP, _table, query
from skein.sources.shared import shared_folder

_INT = f"list_transform(embedding::DOUBLE[], lambda x: CAST(floor(greatest(least({tree.SCALE} * x, {tree.LARGEST}), -{tree.LARGEST})) AS BIGINT))"


def _mean(rows: str) -> str:
    parts = f"SELECT c, unnest(vector) AS x, unnest(range(1, len(vector) + 1)) AS d FROM {rows}"
    return f"SELECT c, list(s ORDER BY d) AS vector FROM (SELECT c, d, CAST(floor(sum(x)::DOUBLE / count(*)) AS BIGINT) AS s FROM ({parts}) GROUP BY c, d) GROUP BY c"


def _assign(nodes: str, centroids: str) -> str:
    far = "list_distance(n.vector::DOUBLE[], s.vector::DOUBLE[])"
    return f"SELECT n.node_id, n.vector, n.leaves, s.c FROM {nodes} n, {centroids} s QUALIFY row_number() OVER (PARTITION BY n.node_id ORDER BY {far}, s.c) = 1"


def _tree_sql() -> str:
    """Common tables whose last, ``tree``, holds every node: each level in plain joins and counts."""
    steps = [f"n0 AS MATERIALIZED (SELECT '0:' || vec_id AS node_id, {_INT} AS vector, 1 AS leaves FROM embeddings)"]
    members = []
    for k in range(tree.LEVELS):
        steps += [
            f"s{k} AS MATERIALIZED (SELECT row_number() OVER (ORDER BY md5(node_id), node_id) - 1 AS c, vector FROM n{k} QUALIFY c < least({tree.MOST}, greatest(1, (SELECT count(*) FROM n{k}) // {tree.BRANCH})))",
            f"a{k} AS MATERIALIZED ({_assign(f'n{k}', f's{k}')})",
            f"m{k} AS MATERIALIZED (SELECT s.c, coalesce(m.vector, s.vector) AS vector FROM s{k} s LEFT JOIN ({_mean(f'a{k}')}) m ON s.c = m.c)",
            f"b{k} AS MATERIALIZED ({_assign(f'n{k}', f'm{k}')})",
            f"big{k} AS MATERIALIZED (SELECT c, count(*) AS members, sum(leaves) AS leaves FROM b{k} GROUP BY c HAVING count(*) >= {tree.LEAST})",
            f"kept{k} AS MATERIALIZED (SELECT b.* FROM b{k} b JOIN big{k} g ON b.c = g.c)",
            f"new{k} AS MATERIALIZED (SELECT '{k + 1}:' || g.c AS node_id, m.vector, g.leaves FROM big{k} g JOIN ({_mean(f'kept{k}')}) m ON g.c = m.c)",
            f"n{k + 1} AS MATERIALIZED (SELECT * FROM new{k} UNION ALL SELECT node_id, vector, leaves FROM b{k} WHERE c NOT IN (SELECT c FROM big{k}))",
        ]
        members.append(f"SELECT node_id, vector, leaves, '{k + 1}:' || c AS parent_id FROM kept{k}")
    last = f"SELECT node_id, vector, leaves, NULL AS parent_id FROM n{tree.LEVELS}"
    return ",\n".join([*steps, f"tree AS MATERIALIZED ({' UNION ALL '.join([*members, last])})"])


TREE_SQL = _tree_sql()
_LEVEL = "CAST(split_part(t.node_id, ':', 1) AS INTEGER) AS level"


@query(
    f"""WITH {TREE_SQL}
SELECT t.node_id, {_LEVEL}, t.parent_id, CAST(t.leaves AS BIGINT) AS leaves, CAST((SELECT count(*) FROM tree c WHERE c.parent_id = t.node_id) AS BIGINT) AS children, md5(array_to_string(t.vector, ',')) AS vector_hash FROM tree t"""
)
def cluster_tree(spark, sf_dir):
    """Every node of the tree over all embeddings."""
    nodes = tree.build_tree(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return nodes.select("node_id", "level", "parent_id", "leaves", "children", tree.vector_hash(F.col("vector")).alias("vector_hash"))


@query(
    f"""WITH {TREE_SQL}, q AS (SELECT vector FROM n0 WHERE node_id = '0:0')
SELECT t.node_id, {_LEVEL}, round(list_cosine_similarity(t.vector::DOUBLE[], q.vector::DOUBLE[]), 6) AS score FROM tree t, q ORDER BY score DESC, node_id LIMIT {TOP}"""
)
def cluster_tree_search(spark, sf_dir):
    """The nodes of all levels nearest to the first vector, by opening the most promising subtrees of the written tree."""
    nodes = tree.build_tree(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    path = f"{shared_folder(spark)}/skein-tree-{uuid.uuid4().hex}"
    tree.write_tree(nodes, path)
    wanted = spark.read.parquet(path).where("node_id = '0:0'").select("vector").first()
    found = tree.search_tree(spark, path, [float(x) for x in wanted[0]], TOP).rows if wanted else []
    return spark.createDataFrame(found, "node_id string, level int, score double")


@query(
    f"""WITH RECURSIVE {TREE_SQL}, up AS (SELECT parent_id AS node_id, 1 AS steps FROM tree WHERE node_id = '0:0' AND parent_id IS NOT NULL
  UNION ALL SELECT t.parent_id, u.steps + 1 FROM up u JOIN tree t ON t.node_id = u.node_id WHERE t.parent_id IS NOT NULL)
SELECT u.node_id, u.steps, CAST(t.leaves AS BIGINT) AS leaves FROM up u JOIN tree t ON t.node_id = u.node_id"""
)
def cluster_tree_ancestors(spark, sf_dir):
    nodes = tree.build_tree(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return tree.ancestors_of(tree.cut(nodes), "0:0").select("node_id", "steps", "leaves")
