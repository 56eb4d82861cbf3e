"""Lines of container logs in stages, and readings of dashboards.

A line is JSON around the output of a container, its stream, a time and attributes, which are JSON again and hold a
tag whose part before the first bar names the container. A line that is no JSON is its own output, without labels, at the
time when it came; so is the time of a line whose own cannot be read. Null lines are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a line has, and where in a tag the container's name stands.
LINE = "log string, stream string, attrs string, time string"
CONTAINER = r"([^|]*)\|"


def staged(lines: DataFrame, line: str = "line", came: str = "came") -> DataFrame:
    """``lines`` with ``output``, ``at`` and ``labels``: JSON, JSON of the attributes, pattern of the tag, time, labels, output."""
    rows = lines.where(F.col(line).isNotNull()).withColumn("_json", F.from_json(line, LINE))
    rows = rows.withColumn("_fine", F.try_parse_json(line).isNotNull() & F.coalesce(F.col("_json.log").isNotNull(), F.lit(False)))
    tag = F.get_json_object("_json.attrs", "$.tag")
    container = F.when(tag.rlike(CONTAINER), F.regexp_extract(tag, CONTAINER, 1))
    at = F.coalesce(F.try_to_timestamp("_json.time"), F.col(came).cast("timestamp"))
    labels = F.map_filter(F.create_map(F.lit("stream"), F.col("_json.stream"), F.lit("container_name"), container), lambda _, v: v.isNotNull())
    none = F.create_map().cast("map<string,string>")
    return rows.withColumns(
        {
            "output": F.when(F.col("_fine"), F.col("_json.log")).otherwise(F.col(line)),
            "at": F.when(F.col("_fine"), at).otherwise(F.col(came).cast("timestamp")),
            "labels": F.when(F.col("_fine"), labels).otherwise(none),
        }
    ).drop("_json", "_fine")


def either(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """All series of ``first``, and those of ``second`` whose labels it lacks; null labels are equal."""
    own = first.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return first.unionByName(second.join(own, same, "left_anti"))


def last_readings(samples: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(<keys>, last, mean, n) of each series: its last value that is there, and the mean of all that are."""
    there = samples.where("value IS NOT NULL")
    return there.groupBy(*keys).agg(F.max_by("value", F.struct(*order)).alias("last"), F.avg("value").alias("mean"), F.count("*").alias("n"))


def band(value: Column, steps: list[tuple[float | None, str]]) -> Column:
    """The name of the last step that a value reaches; the first one has no threshold. Null without a value."""
    (_, name), *rest = steps
    out = F.lit(name)
    for least, name in sorted(rest, key=lambda s: s[0]):
        out = F.when(value >= least, name).otherwise(out)
    return F.when(value.isNotNull(), out)
