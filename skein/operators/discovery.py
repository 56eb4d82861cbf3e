"""File discovery: change sets, priorities, histograms, sums, validation.

Defined results: null sizes add nothing; files of equal rank keep their order or go by path; null paths
are counted together; empty tables give empty results, sums of them zero.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import basename, extension, importance
from skein.operators.graph import cut


def change_set(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(path, change) of ``path, hash`` tables: added, removed or modified; one full join tells all three."""
    old = previous.select("path", F.col("hash").alias("old"), F.lit(True).alias("had"))
    new = current.select("path", F.col("hash").alias("new"), F.lit(True).alias("has"))
    both = old.join(new, "path", "full")
    # a hash that could not be read counts as a change of a file that was there
    change = F.when(F.col("had").isNull(), "added").when(F.col("has").isNull(), "removed").when(F.col("new").isNull() | (F.col("old").isNotNull() & (F.col("old") != F.col("new"))), "modified")
    return both.select("path", change.alias("change")).where("change is not null")


def prioritised(files: DataFrame, dirty: DataFrame, limit: int) -> DataFrame:
    """``files(path, ord)``: dirty ones first as they come, then by importance; ``limit`` at most."""
    flags = files.join(dirty.select("path").distinct().withColumn("dirty", F.lit(True)), "path", "left").withColumn("dirty", F.coalesce("dirty", F.lit(False)))
    scored = flags.withColumn("score", F.when(F.col("dirty"), 0).otherwise(importance(F.col("path"))))
    return scored.orderBy(F.desc("dirty"), F.desc("score"), "ord").limit(limit)


def type_histogram(files: DataFrame) -> DataFrame:
    return files.groupBy(extension(F.col("path")).alias("ext")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


#: Folders that hold no source of a project.
BUILT_FOLDERS = ["node_modules", "dist", "build"]


def project_stats(files: DataFrame) -> DataFrame:
    """Counts of files by language; hidden files and folders, and built ones, do not count."""
    ext = extension(F.col("path"))
    hidden = F.col("path").rlike(r"(^|/)\.") | F.col("path").rlike(rf"(^|/)({'|'.join(BUILT_FOLDERS)})/")
    return files.where(~hidden).agg(
        F.count("*").alias("total_files"),
        F.count_if(ext.isin("ts", "tsx")).alias("typescript_files"),
        F.count_if(ext.isin("js", "jsx")).alias("javascript_files"),
        F.count_if(ext.isin("py", "pyi")).alias("python_files"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"),
    )


def missing_important(files: DataFrame, names: list[str], by: list[str] | None = None) -> DataFrame:
    """(<by>, name) of the ``names`` that no file of ``files(<by>, path)`` has; ``by`` tells repositories apart."""
    own = basename(F.col("path"))
    found = files.groupBy(*(by or [])).agg(F.collect_set(F.when(own.isin(names), own)).alias("found"))
    return found.select(*(by or []), F.explode(F.array_except(F.array(*[F.lit(n) for n in names]), "found")).alias("name"))


def running_total(rows: DataFrame, value: str, order: list[Column]) -> DataFrame:
    """``rows`` with ``running``, the sum of ``value`` up to and with each row in a total ``order``; nulls add nothing.

    Rows are dealt by ranges of the order, each range is summed by itself, and the sums of the ranges before it, one row
    each, are added. No task sees more than a range.
    """
    dealt = cut(rows.repartitionByRange(*order)).withColumn("_range", F.spark_partition_id())
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = dealt.groupBy("_range").agg(F.coalesce(F.sum(value), F.lit(0)).alias("_sum"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    bases = sums.select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    summed = dealt.withColumn("running", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    # as many rows as there are partitions
    return summed.join(F.broadcast(bases), "_range").withColumn("running", F.col("running") + F.col("_base")).drop("_range", "_base")


def running_within(rows: DataFrame, value: str, keys: list[str], order: list[Column]) -> DataFrame:
    """``rows`` with ``running`` within each group of ``keys``, and ``total`` of the group; a group may be as large as all others together."""
    summed = running_total(rows, value, [*[F.col(k) for k in keys], *order])
    groups = summed.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min(F.col("running") - F.coalesce(value, F.lit(0))).alias("_base"), F.sum(value).alias("total"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return summed.join(groups, same).withColumn("running", F.col("running") - F.col("_base")).drop("_base", *[f"_{k}" for k in keys])


def sharded(files: DataFrame, limit: int) -> DataFrame:
    """Shard of each file of a bundle of ``files(path, size)``: the bytes before it, in order of paths, over the limit."""
    return running_total(files, "size", [F.col("path")]).withColumn("shard", F.floor((F.col("running") - F.coalesce("size", F.lit(0))) / limit)).drop("running")


#: Bytes of a bundle from which a warning is due, and of a shard.
BUNDLE_WARNING, BUNDLE_LIMIT = 1_500_000_000, 2_000_000_000


def bundle_size(files: DataFrame, *, warning: int = BUNDLE_WARNING, limit: int = BUNDLE_LIMIT) -> DataFrame:
    """Bytes of a bundle, whether they are worth a warning, and how many shards they make."""
    total = F.coalesce(F.sum("size"), F.lit(0))
    return files.agg(total.alias("bytes"), (total >= warning).alias("warned"), F.greatest(F.lit(1), F.ceil(total / limit)).alias("shards"))


def within_budget(files: DataFrame, budget: int, order: list[Column]) -> DataFrame:
    """The first ``files(path, size)`` in an order that together are no larger than the budget: a prefix."""
    return running_total(files, "size", order).where(F.col("running") <= budget)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)
