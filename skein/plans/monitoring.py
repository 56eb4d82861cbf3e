"""Registered queries over log lines and readings, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import logs, telemetry
from skein.plans.queries import _table, query


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of a container's log; every fiftieth is plain, every fifth user has no tag, every seventh line a time that is none."""
    i, user = F.col("event_id"), F.col("user_id")
    log = F.concat(F.lit("user "), user, F.lit(" "), "event_type")
    attrs = F.to_json(F.struct(F.when(user % 5 != 0, F.concat("event_type", F.lit("|"), user)).alias("tag")))
    time = F.when(i % 7 == 0, "yesterday").otherwise(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    line = F.to_json(F.struct(log.alias("log"), F.when(F.col("value") > 20, "stderr").otherwise("stdout").alias("stream"), attrs.alias("attrs"), time.alias("time")))
    return _table(spark, sf_dir, "events").select(i, F.when(i % 50 == 0, F.concat(F.lit("plain "), i)).otherwise(line).alias("line"), (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("came"))


@query(
    """SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'plain ' || event_id ELSE 'user ' || user_id || ' ' || event_type END AS output,
  CASE WHEN event_id % 50 <> 0 THEN CASE WHEN value > 20 THEN 'stderr' ELSE 'stdout' END END AS stream, CASE WHEN event_id % 50 <> 0 AND user_id % 5 <> 0 THEN event_type END AS container,
  epoch_us(CASE WHEN event_id % 50 = 0 OR event_id % 7 = 0 THEN ts + INTERVAL 1 DAY ELSE ts END) AS micros FROM events"""
)
def staged_logs(spark, sf_dir):
    out = logs.staged(_lines(spark, sf_dir))
    label = lambda n: F.try_element_at("labels", F.lit(n))
    return out.select("event_id", "output", label("stream").alias("stream"), label("container_name").alias("container"), F.unix_micros("at").alias("micros"))


_SERIES = "SELECT user_id, event_type, count(*) AS n FROM events WHERE value {} 20 GROUP BY 1, 2"


@query(f"WITH a AS ({_SERIES.format('>')}), b AS ({_SERIES.format('<=')}) SELECT * FROM a UNION ALL SELECT * FROM b WHERE (user_id, event_type) NOT IN (SELECT user_id, event_type FROM a)")
def either_series(spark, sf_dir):
    """Counts of high values of each user and kind, and of low ones where there is no high one."""
    events = _table(spark, sf_dir, "events")
    counted = lambda rows: rows.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return logs.either(counted(events.where("value > 20")), counted(events.where("value <= 20")), ["user_id", "event_type"])


@query(
    """WITH v AS (SELECT user_id, event_id, CASE WHEN event_type <> 'view' THEN value END AS value FROM events)
SELECT user_id, arg_max(value, event_id) FILTER (value IS NOT NULL) AS last, round(avg(value), 6) AS mean, count(value) AS n,
  CASE WHEN avg(value) >= 30 THEN 'red' WHEN avg(value) >= 20 THEN 'yellow' ELSE 'green' END AS band FROM v GROUP BY 1 HAVING count(value) > 0"""
)
def last_readings(spark, sf_dir):
    """The last value and the mean of each user, views having none, and its colour."""
    value = F.when(F.col("event_type") != "view", F.col("value"))
    out = logs.last_readings(_table(spark, sf_dir, "events").select("user_id", "event_id", value.alias("value")), ["user_id"], ["event_id"])
    return out.withColumn("band", logs.band(F.col("mean"), [(None, "green"), (20, "yellow"), (30, "red")])).withColumn("mean", F.round("mean", 6))


@query(
    """SELECT event_type, count(*) AS requests, round(count(*) FILTER (value < 30) / count(*)::DOUBLE, 6) AS success_rate,
  round(count(*) / (epoch_us(max(ts)) / 1000000 - epoch_us(min(ts)) / 1000000)::DOUBLE, 9) AS per_second FROM events GROUP BY 1"""
)
def load_rates(spark, sf_dir):
    """Requests of each kind, how many took less than thirty, and how many came in a second."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    out = telemetry.load_rates(_table(spark, sf_dir, "events"), ["event_type"], F.col("value") < 30, seconds)
    return out.select("event_type", "requests", F.round("success_rate", 6).alias("success_rate"), F.round("per_second", 9).alias("per_second"))
