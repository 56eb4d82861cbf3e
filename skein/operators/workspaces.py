"""Packages of a repository: the nearest folder above each file that holds a package's marker.

Each path is joined by key with the roots through the folders above it, a few rows a file, instead of by prefix with
all roots. Files below no root belong to the repository, the empty root. Null paths are left out; a marker at the
top makes the repository itself a package.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Files that mark the root of a package.
MARKERS = ["package.json", "pyproject.toml", "setup.py", "Cargo.toml", "go.mod", "pom.xml"]


def folders_above(path: Column) -> Column:
    """The folders of a path, nearest last; the top is the empty one."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def roots(files: DataFrame, markers: list[str] | None = None) -> DataFrame:
    name = F.substring_index("path", "/", -1)
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    return files.where(name.isin(markers or MARKERS)).select(folder.alias("root")).distinct()


def assigned(files: DataFrame, packages: DataFrame) -> DataFrame:
    """``files`` with ``root``, the longest of ``packages(root)`` above each."""
    known = files.where("path IS NOT NULL")
    above = known.select("path", F.explode(folders_above(F.col("path"))).alias("root"))
    nearest = above.join(packages, "root", "left_semi").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    return known.join(nearest, "path", "left").withColumn("root", F.coalesce("root", F.lit("")))


def totals(files: DataFrame) -> DataFrame:
    """Of ``assigned`` files with ``size``: number and bytes of each root, and how many kinds of files."""
    return files.groupBy("root").agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count_distinct(F.regexp_extract("path", r"\.([^./]*)$", 1)).alias("kinds"))
