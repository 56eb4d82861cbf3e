"""Registered queries that run as streams over the events, each with the SQL of its batch form."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import telemetry
from skein.plans.queries import _table, query
from skein.sources.shared import shared_folder
from skein.streaming import alerts, metrics

#: How late events may be: more than all of them span, so the order of files does not matter.
LATE_DAYS = 400


def _until(spark: SparkSession, sf_dir: str) -> datetime:
    """Midnight after the day after the last event."""
    last = _table(spark, sf_dir, "events").agg(F.date_trunc("day", F.max("ts")).alias("d")).first()[0]
    return (last or datetime(2024, 1, 1)) + timedelta(days=2)


_UNTIL_SQL = "(SELECT epoch_us(date_trunc('day', max(ts)) + INTERVAL 2 DAY) FROM events)"


def _streamed(rows: DataFrame, key: str, until: datetime, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Let rows arrive in a folder, then one without a key that moves the watermark to ``until``; give what the stream wrote."""
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/skein-stream-{uuid.uuid4().hex}"
    end = spark.createDataFrame([(until + timedelta(days=LATE_DAYS),)], "ts timestamp_ntz").withColumn("ts", F.col("ts").cast(rows.schema["ts"].dataType))
    rows.write.parquet(f"{folder}/arrived/events")
    rows.limit(0).unionByName(end, allowMissingColumns=True).coalesce(1).write.parquet(f"{folder}/arrived/end")
    out = make(metrics.read_events(spark, f"{folder}/arrived/*", rows.schema))
    write = out.writeStream.format("parquet").option("path", f"{folder}/told").option("checkpointLocation", f"{folder}/checkpoint")
    write.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/told").where(F.col(key).isNotNull())


_TRANSITIONS_SQL = """WITH m AS (SELECT event_type, epoch_us(ts) AS us, max(value > 20) AS on_ FROM events GROUP BY 1, 2),
r AS (SELECT *, coalesce(lag(on_) OVER w, false) AS before, sum(CASE WHEN on_ THEN 0 ELSE 1 END) OVER w AS run FROM m WINDOW w AS (PARTITION BY event_type ORDER BY us)),
s AS (SELECT *, CASE WHEN on_ THEN min(us) FILTER (on_) OVER (PARTITION BY event_type, run) END AS since FROM r),
f AS (SELECT *, on_ AND us - since >= 600000000 AS fired FROM s),
g AS (SELECT *, coalesce(lag(fired) OVER (PARTITION BY event_type ORDER BY us), false) AS fired_before FROM f)
SELECT event_type, us AS "at", 'pending' AS state FROM g WHERE on_ AND NOT before
UNION ALL SELECT event_type, us, 'firing' FROM g WHERE fired AND NOT fired_before
UNION ALL SELECT event_type, us, CASE WHEN fired_before THEN 'resolved' ELSE 'inactive' END FROM g WHERE before AND NOT on_"""


@query(_TRANSITIONS_SQL)
def alert_transitions(spark, sf_dir):
    return telemetry.transitions(_table(spark, sf_dir, "events"), ["event_type"], F.col("value") > 20, 600)


@query(_TRANSITIONS_SQL)
def streamed_transitions(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select("event_type", "value", "ts")
    make = lambda s: alerts.transitions(s, ["event_type"], F.col("value") > 20, 600, late=f"{LATE_DAYS} days")
    return _streamed(events, "event_type", _until(spark, sf_dir), make)


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes of alerts: errors are critical, purchases warnings, high values fire."""
    severity = F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "purchase", "warning").otherwise("info")
    state = F.when(F.col("value") > 15, telemetry.FIRING).otherwise(telemetry.RESOLVED)
    return _table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("service"), F.col("event_id").alias("id"), severity.alias("severity"), state.alias("state"), "ts")


_CHANGES_SQL = """SELECT user_id % 7 AS service, event_id AS id, CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'warning' ELSE 'info' END AS severity,
  CASE WHEN value > 15 THEN 'firing' ELSE 'resolved' END AS state, epoch_us(ts) AS us FROM events"""
_INHIBITED_SQL = f"""WITH c AS ({_CHANGES_SQL}),
o AS (SELECT *, coalesce(sum(CASE WHEN severity <> 'critical' THEN 0 WHEN state = 'firing' THEN 1 ELSE -1 END) OVER (PARTITION BY service ORDER BY us RANGE UNBOUNDED PRECEDING), 0) AS open FROM c)
SELECT service, us AS "at", id, severity, state FROM o WHERE severity <> 'warning' OR open <= 0"""


@query(_INHIBITED_SQL)
def inhibited_changes(spark, sf_dir):
    return telemetry.inhibited_changes(_changes(spark, sf_dir), ["service"])


@query(_INHIBITED_SQL)
def streamed_inhibition(spark, sf_dir):
    make = lambda s: alerts.inhibited(s, ["service"], late=f"{LATE_DAYS} days")
    return _streamed(_changes(spark, sf_dir), "service", _until(spark, sf_dir), make)


_SETTINGS = {"wait": 600, "interval": 3600, "repeat": 6 * 3600}
_GROUP = ["receiver", "service"]
_NOTICES_SQL = f"""WITH c AS (SELECT *, CASE severity WHEN 'critical' THEN 'critical-alerts' WHEN 'high' THEN 'high-alerts' WHEN 'warning' THEN 'warning-alerts' ELSE 'web.hook' END AS receiver FROM ({_CHANGES_SQL})),
b AS (SELECT *, min(us) OVER (PARTITION BY receiver, service) AS begun FROM c),
t AS (SELECT receiver, service, begun, CAST(greatest(0, ceil((us - begun - 600000000) / 3600000000::DOUBLE)) AS BIGINT) AS nth, count(*) AS changes, sum(CASE state WHEN 'firing' THEN 1 ELSE -1 END) AS step FROM b GROUP BY 1, 2, 3, 4),
o AS (SELECT *, sum(step) OVER w AS open, CAST(floor(({_UNTIL_SQL} - begun - 600000000) / 3600000000::DOUBLE) AS BIGINT) AS last, lead(nth) OVER w AS later FROM t WINDOW w AS (PARTITION BY receiver, service ORDER BY nth)),
n AS (SELECT *, coalesce(later - 1, last) AS next FROM o WHERE nth <= last),
a AS (SELECT receiver, service, begun, nth, changes, open, false AS again FROM n
  UNION ALL SELECT receiver, service, begun, unnest(range(nth + 6, next + 1, 6)), 0, open, true FROM n WHERE open > 0)
SELECT receiver, service, nth, begun + 600000000 + nth * 3600000000 AS "at", changes, CAST(open AS BIGINT) AS open, again FROM a"""


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).withColumn("receiver", telemetry.receiver(F.col("severity")))


def _micros(moment: datetime) -> int:
    return (moment - datetime(1970, 1, 1)) // timedelta(microseconds=1)


@query(_NOTICES_SQL)
def alert_notices(spark, sf_dir):
    return telemetry.notices(_routed(spark, sf_dir), _GROUP, until=_micros(_until(spark, sf_dir)), **_SETTINGS)


@query(_NOTICES_SQL)
def streamed_notices(spark, sf_dir):
    make = lambda s: alerts.notices(s, _GROUP, late=f"{LATE_DAYS} days", **_SETTINGS)
    return _streamed(_routed(spark, sf_dir), "service", _until(spark, sf_dir), make)


@query(
    """WITH RECURSIVE g AS (SELECT user_id, min(ts) AS begun FROM events GROUP BY 1
  UNION ALL SELECT g.user_id, min(e.ts) FROM g JOIN events e ON e.user_id = g.user_id AND e.ts > g.begun + INTERVAL 1 HOUR GROUP BY g.user_id, g.begun)
SELECT g.user_id AS trace, epoch_us(g.begun) AS begun, count(*) AS spans, 'waited' AS reason FROM g JOIN events e ON e.user_id = g.user_id AND e.ts >= g.begun AND e.ts <= g.begun + INTERVAL 1 HOUR GROUP BY 1, 2"""
)
def streamed_traces(spark, sf_dir):
    """Events of a user within an hour of the first, as one trace; at most a thousand times the shards are open."""
    spans = _table(spark, sf_dir, "events").select("user_id", "ts")
    make = lambda s: alerts.grouped_traces(s, "user_id", wait_seconds=3600, most=16_000, shards=16, late=f"{LATE_DAYS} days")
    return _streamed(spans, "trace", _until(spark, sf_dir), make)


@query("SELECT DISTINCT user_id, event_type FROM events")
def streamed_progress(spark, sf_dir):
    """One notification for each user and kind of event."""
    events = _table(spark, sf_dir, "events").select("user_id", "event_type", "ts")
    return _streamed(events, "user_id", _until(spark, sf_dir), lambda s: alerts.progress(s, ["user_id", "event_type"], late=f"{LATE_DAYS} days").select("user_id", "event_type"))


@query(
    """WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT user_id, epoch_us(min(ts)) AS begun, count(*) AS changes FROM s GROUP BY user_id, k"""
)
def streamed_settled(spark, sf_dir):
    """Bursts of a user's events that half an hour without one ends."""
    events = _table(spark, sf_dir, "events").select("user_id", "ts")
    make = lambda s: alerts.settled(s, "user_id", gap="30 minutes", late=f"{LATE_DAYS} days")
    return _streamed(events, "user_id", _until(spark, sf_dir), make).select("user_id", F.unix_micros("begun").alias("begun"), "changes")


@query(
    """WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, arg_max(ts, event_id) AS ts FROM events GROUP BY 1)
SELECT user_id, event_type, value FROM l WHERE event_type <> 'error' AND ts >= (SELECT max(ts) FROM events) - INTERVAL 2 DAY"""
)
def streamed_current(spark, sf_dir):
    """The last event of each user, kept by a stream: users whose last one is an error are gone, those that are two days old have expired."""
    folder = f"{shared_folder(spark)}/skein-current-{uuid.uuid4().hex}"
    events = _table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "ts", (F.col("event_type") == "error").alias("gone"))
    events.repartition(2).write.parquet(f"{folder}/arrived")
    arrived = metrics.read_events(spark, f"{folder}/arrived", events.schema, files_per_batch=1)
    metrics.upsert_latest(arrived, f"{folder}/table", f"{folder}/checkpoint", "user_id", "event_id", buckets=8).trigger(availableNow=True).start().awaitTermination()
    schema = events.schema.simpleString()[7:-1].replace(":", " ")
    last = events.agg(F.max("ts")).first()[0]
    if last is not None:
        metrics.expire(spark, f"{folder}/table", schema, "user_id", F.col("ts") < F.lit(last - timedelta(days=2)), buckets=8)
    return metrics.read_latest(spark, f"{folder}/table", schema, gone="gone").select("user_id", "event_type", "value")
