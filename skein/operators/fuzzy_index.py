"""Lookup of names within a few edits through an index of shortened names.

Two names within d edits share a string that deleting up to d characters from either leaves. The index holds
these strings as keys, so a lookup is a join by key and a check of what it brings. Names beyond ``LONG`` characters
have too many of them and are kept by length instead. Lookup ignores case; null names have no key; equal names are one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONG = 40


def shortened(name: Column, edits: int) -> Column:
    """All strings that deleting up to ``edits`` characters leaves, the name itself among them."""
    every = F.array(name)
    for _ in range(edits):
        fewer = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
        every = F.array_distinct(F.concat(every, F.flatten(F.transform(every, lambda w: F.when(F.length(w) > 0, fewer(w)).otherwise(F.array().cast("array<string>"))))))
    return every


def index(names: DataFrame, edits: int) -> DataFrame:
    """(key, name) of the different ``names(name)``."""
    own = names.where("name IS NOT NULL").select(F.lower("name").alias("name")).distinct()
    size = F.length("name")
    by_length = F.array(F.concat(F.lit("#"), size))
    return own.select(F.explode(F.when(size <= LONG, F.transform(shortened(F.col("name"), edits), lambda w: F.concat(F.lit("="), w))).otherwise(by_length)).alias("key"), "name")


def lookup(indexed: DataFrame, asked: DataFrame, edits: int) -> DataFrame:
    """(asked, name, distance) for ``asked(asked)``: all indexed names within ``edits``, nearest by Levenshtein distance."""
    own = asked.where("asked IS NOT NULL").select(F.lower("asked").alias("asked")).distinct()
    size, none = F.length("asked"), F.array().cast("array<string>")
    short = F.when(size <= LONG + edits, F.transform(shortened(F.col("asked"), edits), lambda w: F.concat(F.lit("="), w))).otherwise(none)
    lengths = F.transform(F.sequence(F.greatest(size - edits, F.lit(LONG + 1)), size + edits), lambda n: F.concat(F.lit("#"), n))
    keys = F.concat(short, F.when(size + edits > LONG, lengths).otherwise(none))
    # a pair may share many keys
    pairs = own.select("asked", F.explode(keys).alias("key")).join(indexed.hint("merge"), "key").select("asked", "name").distinct()
    return pairs.withColumn("distance", F.levenshtein("asked", "name", edits)).where("distance >= 0")
