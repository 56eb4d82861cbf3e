"""Metric, alert, log and session operators over event tables.

Series are told by key columns; null keys form a series of their own. Samples without a time take no part
in windows; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from skein.operators.discovery import running_within


#: States of an alert.
PENDING, FIRING, RESOLVED, INACTIVE = "pending", "firing", "resolved", "inactive"
#: Who gets alerts of a severity, and who gets all others.
RECEIVERS = {"critical": "critical-alerts", "high": "high-alerts", "warning": "warning-alerts"}
OTHER_RECEIVER = "web.hook"


def counter_increase(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Each sample of ``ts, value`` with its growth since the one before; a drop is a reset from zero."""
    order = Window.partitionBy(*keys).orderBy("ts")
    before = F.lag("value").over(order)
    return samples.withColumn("increase", F.when(before.isNull(), 0.0).when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before))


def rate(samples: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """Growth per second in tumbling windows of ``seconds``."""
    grown = counter_increase(samples, keys)
    return grown.groupBy(*keys, F.window(F.col("ts").cast("timestamp"), f"{seconds} seconds").alias("w")).agg(F.sum("increase").alias("increase")).select(*keys, F.col("w.start").alias("window_start"), (F.col("increase") / seconds).alias("rate"))


def histogram_quantile(buckets: DataFrame, keys: list[str], q: float) -> DataFrame:
    """Linear interpolation in cumulative ``le, count`` buckets; in the last one its lower bound."""
    order = Window.partitionBy(*keys).orderBy("le")
    total = F.max("count").over(Window.partitionBy(*keys))
    marked = buckets.withColumn("below", F.coalesce(F.lag("count").over(order), F.lit(0))).withColumn("lower", F.coalesce(F.lag("le").over(order), F.lit(0.0))).withColumn("wanted", total * q)
    hit = marked.where(F.col("count") >= F.col("wanted"))
    first = hit.withColumn("nth", F.row_number().over(order)).where("nth = 1")
    inside = F.col("lower") + (F.col("le") - F.col("lower")) * F.try_divide(F.col("wanted") - F.col("below"), F.col("count") - F.col("below"))
    return first.select(*keys, F.when(F.col("le") == float("inf"), F.col("lower")).otherwise(inside).alias("quantile"))


def sessions(events: DataFrame, key: str, gap: str) -> DataFrame:
    window = F.session_window(F.col("ts").cast("timestamp"), gap)
    return events.groupBy(key, window.alias("w")).agg(F.count("*").alias("n_events"), F.max("ts").alias("last_ts")).select(key, F.col("w.start").alias("session_start"), "last_ts", "n_events")


def firing(points: DataFrame, keys: list[str], condition: Column, hold_seconds: int) -> DataFrame:
    """Runs of samples where a condition stays true, at least ``hold_seconds`` long: gaps and islands."""
    order = Window.partitionBy(*keys).orderBy("ts")
    flagged = points.withColumn("on", F.coalesce(condition, F.lit(False)))
    change = (F.col("on") != F.coalesce(F.lag("on").over(order), F.lit(False))).cast("int")
    islands = flagged.withColumn("changed", change).withColumn("island", F.sum("changed").over(order)).where("on")
    runs = islands.groupBy(*keys, "island").agg(F.min("ts").alias("pending_since"), F.max("ts").alias("last_true"), F.count("*").alias("samples"))
    return runs.where(F.col("last_true").cast("timestamp").cast("long") - F.col("pending_since").cast("timestamp").cast("long") >= hold_seconds).drop("island")


def transitions(points: DataFrame, keys: list[str], condition: Column, hold_seconds: int) -> DataFrame:
    """(<keys>, at, state): when an alert begins to be pending, fires after ``hold_seconds``, and ends.

    Samples of one moment count as one, on if any is. An alert that ends before it fires is inactive, else resolved.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    moments = points.where("ts IS NOT NULL").groupBy(*keys, at.alias("at")).agg(F.max(F.coalesce(condition, F.lit(False))).alias("on"))
    order = Window.partitionBy(*keys).orderBy("at")
    before = F.coalesce(F.lag("on").over(order), F.lit(False))
    marked = moments.withColumn("before", before).withColumn("begins", F.col("on") & ~before)
    marked = marked.withColumn("since", F.last(F.when(F.col("begins"), F.col("at")), ignorenulls=True).over(order))
    hold = F.col("at") - F.col("since") >= hold_seconds * 1_000_000
    # of this moment and of the one before it in the same run
    fired = marked.withColumn("fired", F.col("on") & hold)
    fired = fired.withColumn("fired_before", F.coalesce(F.lag("fired").over(order), F.lit(False)))
    states = F.array_compact(
        F.array(
            F.when(F.col("begins"), PENDING),
            F.when(F.col("fired") & (F.col("begins") | ~F.col("fired_before")), FIRING),
            F.when(~F.col("on") & F.col("before"), F.when(F.col("fired_before"), RESOLVED).otherwise(INACTIVE)),
        )
    )
    return fired.select(*keys, "at", F.explode(states).alias("state"))


def inhibited_changes(changes: DataFrame, equal: list[str]) -> DataFrame:
    """(<equal>, at, id, severity, state): changes without those of warnings while a critical alert of equal labels is open.

    What happens to critical alerts at one moment comes before what happens to warnings.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    step = F.when(F.col("severity") == "critical", F.when(F.col("state") == FIRING, 1).when(F.col("state") == RESOLVED, -1))
    order = Window.partitionBy(*equal).orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    open_ = F.coalesce(F.sum("_step").over(order), F.lit(0))
    counted = changes.where("ts IS NOT NULL").withColumn("at", at).withColumn("_step", step).withColumn("_open", open_)
    muted = F.coalesce((F.col("severity") == "warning") & (F.col("_open") > 0), F.lit(False))
    return counted.where(~muted).select(*equal, "at", "id", "severity", "state")


def receiver(severity: Column) -> Column:
    """Who gets alerts of a severity."""
    out = F.lit(OTHER_RECEIVER)
    for name, who in reversed(RECEIVERS.items()):
        out = F.when(severity == name, who).otherwise(out)
    return out


def inhibited(alerts: DataFrame, equal: list[str]) -> DataFrame:
    """Without the warnings that a critical alert with equal labels covers; null labels are equal."""
    critical = alerts.where("severity = 'critical'").select(*[F.col(c).alias(f"_{c}") for c in equal]).distinct()
    same = None
    for c in equal:
        part = F.col(c).eqNullSafe(F.col(f"_{c}"))
        same = part if same is None else same & part
    return alerts.where("severity != 'warning'").unionByName(alerts.where("severity = 'warning'").join(critical, same, "left_anti"))


def absent(expected: DataFrame, series: DataFrame, keys: list[str]) -> DataFrame:
    return expected.join(series.select(*keys).distinct(), keys, "left_anti")


def sampled(traces: DataFrame, key: str, percent: int, seed: int = 22) -> DataFrame:
    """The same share of traces wherever it runs: whole traces, by the first bytes of a hash of seed and trace."""
    first = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")
    return traces.where(first % 100 < percent)


def latest(rows: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max(F.struct(order, *columns)).alias("l")).select(key, *[F.col(f"l.{c}").alias(c) for c in (order, *columns)])


def _seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1_000_000


def sliding_rate(samples: DataFrame, keys: list[str], seconds: int, step: int) -> DataFrame:
    """Growth per second over the last ``seconds``, at every ``step``: (<keys>, at, rate), ``at`` being the window's end."""
    grown = counter_increase(samples, keys)
    window = F.window(F.col("ts").cast("timestamp"), f"{seconds} seconds", f"{step} seconds")
    summed = grown.groupBy(*keys, window.alias("w")).agg(F.sum("increase").alias("increase"))
    return summed.select(*keys, F.unix_seconds("w.end").alias("at"), (F.col("increase") / seconds).alias("rate"))


def mean_over(points: DataFrame, keys: list[str], value: str, seconds: int, step: int) -> DataFrame:
    """Mean of ``points(<keys>, at, value)`` in (at - seconds, at], at every ``step``; over rates, a subquery."""
    last = F.ceil(F.col("at") / step) * step
    spread = points.select(*keys, value, F.explode(F.sequence(last, last + F.lit(seconds - 1), F.lit(step).cast("long"))).alias("until"), "at").where(F.col("at") > F.col("until") - seconds)
    return spread.groupBy(*keys, F.col("until").alias("at")).agg(F.avg(value).alias(value))


def instant(samples: DataFrame, keys: list[str], order: str, step: int, stale: int = 300) -> DataFrame:
    """(<keys>, at, value): the last sample at or before each ``step``, no older than ``stale`` seconds."""
    at = _seconds(F.col("ts"))
    last = (F.ceil(at / step) * step).cast("long")
    spread = samples.where("ts is not null").select(*keys, "value", order, at.alias("_at"), F.explode(F.sequence(last, last + F.lit(stale), F.lit(step).cast("long"))).alias("at"))
    fresh = spread.where(F.col("at") - F.col("_at") <= stale)
    return fresh.groupBy(*keys, "at").agg(F.max_by("value", F.struct("_at", order)).alias("value"))


def matching(series: DataFrame, **labels: tuple[str, str]) -> DataFrame:
    """Series whose labels match: ``("=", x)``, ``("!=", x)``, ``("=~", pattern)`` or ``("!~", pattern)``, patterns for
    the whole label; a missing label is empty."""
    out = series
    for name, (sign, value) in labels.items():
        label = F.coalesce(F.col(name).cast("string"), F.lit(""))
        test = label.rlike(f"^(?:{value})$") if sign.endswith("~") else label == value
        out = out.where(~test if sign.startswith("!") else test)
    return out


def ratio(above: DataFrame, below: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``above / below`` of samples with identical labels; labels that one side alone has drop out, nothing by nothing is null."""
    same = None
    for k in keys:
        part = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        same = part if same is None else same & part
    joined = above.alias("a").join(below.alias("b"), same)
    share = F.try_divide(F.col(f"a.{value}"), F.col(f"b.{value}"))
    return joined.select(*[F.col(f"a.{k}").alias(k) for k in keys], F.when((F.col(f"b.{value}") == 0) & (F.col(f"a.{value}") > 0), F.lit(float("inf"))).otherwise(share).alias("ratio"))


def log_lines(rows: DataFrame, column: str, contains: str, *, without: str | None = None) -> DataFrame:
    """Rows whose ``column`` has ``contains`` and does not match the pattern ``without``."""
    out = rows.where(F.col(column).contains(contains))
    return out.where(~F.col(column).rlike(without)) if without else out


def newest(rows: DataFrame, order: list[str], k: int) -> DataFrame:
    return rows.orderBy(*[F.desc(c) for c in order]).limit(k)


def notifications(alerts: DataFrame, group: list[str], *, wait: int = 10, interval: int = 10) -> DataFrame:
    """(<group>, nth, at, alerts): the first notice of a group ``wait`` seconds after its first alert, then every ``interval``
    seconds one with what came since; none where nothing came."""
    at = _seconds(F.col("ts"))
    begun = alerts.groupBy(*group).agg(F.min(at).alias("_begun"))
    same = None
    for c in group:
        part = F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
        same = part if same is None else same & part
    joined = alerts.withColumn("_at", at).alias("x").join(begun.alias("y"), same)
    nth = F.greatest(F.lit(0), F.ceil((F.col("_at") - F.col("_begun") - wait) / interval)).cast("long")
    told = joined.groupBy(*[F.col(f"x.{c}").alias(c) for c in group], nth.alias("nth"), F.col("_begun").alias("_begun")).agg(F.count("*").alias("alerts"))
    return told.select(*group, "nth", (F.col("_begun") + wait + F.col("nth") * interval).alias("at"), "alerts")


def notices(changes: DataFrame, group: list[str], *, wait: int = 10, interval: int = 10, repeat: int = 3600, until: int) -> DataFrame:
    """(<group>, nth, at, changes, open, again) of ``changes(<group>, ts, state)``, up to ``until`` in microseconds.

    The first notice of a group comes ``wait`` seconds after its first change, then at every ``interval`` one with
    what changed since, and where nothing did, one again ``repeat`` seconds after the last while alerts are open.
    """
    wait, interval, every = wait * 1_000_000, interval * 1_000_000, -(-repeat // interval)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    begun = F.min("_at").over(Window.partitionBy(*group))
    step = F.when(F.col("state") == FIRING, 1).when(F.col("state") == RESOLVED, -1).otherwise(0)
    timed = changes.where("ts IS NOT NULL").withColumn("_at", at).withColumn("_begun", begun)
    late = F.col("_at") - F.col("_begun") - wait
    nth = F.greatest(F.lit(0), -F.floor(-late / interval)).cast("long")
    told = timed.withColumn("nth", nth).groupBy(*group, "_begun", "nth").agg(F.count("*").alias("changes"), F.sum(step).alias("_step"))
    order = Window.partitionBy(*group).orderBy("nth")
    told = told.withColumn("open", F.sum("_step").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    last = F.floor((F.lit(until) - F.col("_begun") - wait) / interval)
    told = told.withColumn("_next", F.coalesce(F.lead("nth").over(order) - 1, last)).where(F.col("nth") <= last)
    news = F.array(F.col("nth"))
    more = F.when((F.col("open") > 0) & (F.col("nth") + every <= F.col("_next")), F.sequence(F.col("nth") + every, F.col("_next"), F.lit(every).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    spread = told.select(*group, "_begun", "changes", "open", F.posexplode(F.concat(news, more)).alias("_k", "nth"))
    again = F.col("_k") > 0
    return spread.select(*group, "nth", (F.col("_begun") + wait + F.col("nth") * interval).alias("at"), F.when(again, 0).otherwise(F.col("changes")).cast("long").alias("changes"), "open", again.alias("again"))


def limited(requests: DataFrame, client: str, order: str, *, rate: float, burst: float) -> DataFrame:
    """``requests`` with ``allowed``: each client's leaky bucket of ``burst`` requests drains at ``rate`` a second.

    A client's requests are looked at one after another, as each decision rests on the one before; a task holds one
    bucket, whatever a client's number of requests. Requests without a time are refused.
    """
    keyed = requests.withColumn("_second", _seconds(F.col("ts")))
    ordered = keyed.repartition(client).sortWithinPartitions(client, "_second", order)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, seen, held, first = None, None, 0.0, True
        for batch in batches:
            allowed = []
            for name, now in zip(batch[client].to_pylist(), batch["_second"].to_pylist(), strict=True):
                if first or name != who:
                    who, seen, held, first = name, None, 0.0, False
                if now is None:
                    allowed.append(False)
                    continue
                left = 0.0 if seen is None else max(0.0, held - (now - seen) * rate)
                allowed.append(left <= burst)
                if left <= burst:
                    held, seen = left + 1, now
            columns = [batch[c] for c in batch.schema.names if c != "_second"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(allowed, pa.bool_())], names=[*[c for c in batch.schema.names if c != "_second"], "allowed"])

    shape = StructType([*requests.schema.fields, StructField("allowed", BooleanType())])
    return ordered.mapInArrow(decide, shape)


def load_statistics(samples: DataFrame, keys: list[str], value: str, share: float = 0.95) -> DataFrame:
    """Number, mean, least, largest and the nearest-rank quantile of each series.

    Equal values are counted before they are ordered, and counts are summed over ranges of values, so a series
    may hold most of the samples.
    """
    counted = samples.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    ranked = running_within(counted, "c", keys, [F.col(value)])
    hit = F.min(F.when(F.col("running") > F.least(F.floor(F.col("total") * share), F.col("total") - 1), F.col(value)))
    return ranked.groupBy(*keys).agg(F.sum("c").alias("n"), (F.sum(F.col(value) * F.col("c")) / F.sum("c")).alias("mean"), F.min(value).alias("least"), F.max(value).alias("largest"), hit.alias("quantile"))


def load_rates(samples: DataFrame, keys: list[str], success: Column, seconds: Column) -> DataFrame:
    """(<keys>, requests, success_rate, per_second): ``success`` tells a request's, ``seconds`` when it came; nothing a second where no time passed."""
    span = F.max(seconds) - F.min(seconds)
    return samples.groupBy(*keys).agg(F.count("*").alias("requests"), (F.count_if(F.coalesce(success, F.lit(False))) / F.count("*")).alias("success_rate"), F.try_divide(F.count("*"), span).alias("per_second"))


def trace_figures(traces: DataFrame, key: str) -> DataFrame:
    """Of ``traces(<key>, session, seconds, success)``: calls, mean time, share of errors, active sessions."""
    failed = F.count_if(~F.coalesce(F.col("success"), F.lit(False)))
    return traces.groupBy(key).agg(F.count("*").alias("calls"), F.avg("seconds").alias("mean_seconds"), (failed / F.count("*")).alias("error_rate"), F.count_distinct("session").alias("sessions"))
