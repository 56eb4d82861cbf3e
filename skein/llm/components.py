"""Connected components of an undirected graph, by alternating large-star and small-star rounds.

Each round is two joins of the links with the smallest neighbour of each node. The smallest neighbours
come from aggregations that combine before the shuffle, and the joins may be split where a node has
very many links. Rounds end when the links no longer change; the links then form stars around the
smallest node of every component. Each round's links are written to the shared folder, so lineage
stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.storage import saved


def rekeyed(df: DataFrame, key: str) -> DataFrame:
    """Give ``df`` an exchange of its own on ``key`` before a join.

    An aggregation leaves its rows dealt by the key, and Spark splits a hot key of a join only where
    both sides come straight from an exchange; the changed expression makes it add one.
    """
    return df.withColumn(key, F.col(key) + F.lit(0))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(rekeyed(least, "a"), "a").where("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(rekeyed(least, "a"), "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component_id) for every node of ``links(a, b)``; the id is the component's smallest node.

    Links from a node to itself are ignored. Nodes without links do not appear.
    """
    links = saved(links.where("a != b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")), "links")
    before = None
    while True:
        links = saved(_small_star(_large_star(links)), "stars")
        # order-free digest of the links: count and sums of hashes
        now = links.agg(
            F.count("*"),
            F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
            F.sum(F.xxhash64("b", "a").cast("decimal(38,0)")),
        ).first()
        if now == before:
            break
        before = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("component_id")).union(links.select(F.col("b").alias("node"), F.col("b").alias("component_id")).distinct())
