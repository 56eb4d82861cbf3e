"""Streams against their batch forms: out-of-order arrival, several batches, a restart from the checkpoint."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skein.operators import telemetry
from skein.streaming import alerts, metrics

START = datetime(2024, 1, 1)
END = datetime(2030, 1, 1)


class Arrivals:
    """A folder in which files arrive, and a stream over it that is stopped after each."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.n = spark, str(folder), schema, 0

    def arrive(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.folder}/in/{self.n:03}")
        self.n += 1

    def run(self, make):
        rows = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in/*")
        out = make(rows)
        out.writeStream.format("parquet").option("path", f"{self.folder}/out").option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        return self.spark.read.schema(out.schema).parquet(f"{self.folder}/out")

    def all(self):
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/in/*")


def shuffled(rows, seed, files):
    """Rows nearly in order of time, dealt over files."""
    pick = random.Random(seed)
    rows = sorted(rows, key=lambda r: r[-1] + timedelta(seconds=pick.uniform(0, 600)))
    size = -(-len(rows) // files)
    return [rows[k : k + size] for k in range(0, len(rows), size)]


def same(got, want, last):
    key = lambda r: tuple(str(x) for x in r)
    columns = sorted(want.columns)
    rows = [tuple(r) for r in got.select(*columns).where(F.col("at") <= last).collect()]
    expected = [tuple(r) for r in want.select(*columns).where(F.col("at") <= last).collect()]
    assert sorted(rows, key=key) == sorted(expected, key=key)
    return rows


LAST = int((datetime(2025, 1, 1) - datetime(1970, 1, 1)).total_seconds()) * 1_000_000


@pytest.mark.parametrize("hold", [0, 120])
def test_transitions(spark, tmp_path, hold):
    pick = random.Random(hold)
    rows = [(pick.choice(["a", "b", None]), pick.choice([0.0, 5.0, 5.0, None]), START + timedelta(seconds=pick.randint(0, 40) * 30)) for _ in range(240)]
    files = Arrivals(spark, tmp_path, "service string, value double, ts timestamp")
    make = lambda s: alerts.transitions(s, ["service"], F.col("value") > 1, hold, late="1 hour")
    parts = shuffled(rows, 1, 3)
    for part in parts:
        files.arrive(part)
        files.run(make)
    files.arrive([("end", 0.0, END)])
    got = files.run(make)
    found = same(got, telemetry.transitions(files.all(), ["service"], F.col("value") > 1, hold), LAST)
    assert {r[-1] for r in found} == ({"pending", "firing", "resolved"} if hold == 0 else {"pending", "firing", "resolved", "inactive"})


def changes(seed, n=150):
    pick = random.Random(seed)
    return [(pick.choice([1, (1 << 60) + 1, None]), pick.randint(1, 5), pick.choice(["critical", "warning", "info", None]), pick.choice(["firing", "resolved", "pending"]), START + timedelta(seconds=pick.randint(0, 400) * 17)) for _ in range(n)]


CHANGES = "service long, id long, severity string, state string, ts timestamp"


def test_inhibition(spark, tmp_path):
    files = Arrivals(spark, tmp_path, CHANGES)
    make = lambda s: alerts.inhibited(s, ["service"], late="1 hour")
    for part in shuffled(changes(3), 2, 2):
        files.arrive(part)
        files.run(make)
    files.arrive([(-1, 0, "info", "firing", END)])
    got = files.run(make)
    rows = same(got, telemetry.inhibited_changes(files.all(), ["service"]), LAST)
    assert 0 < len(rows) < 150


def test_notices(spark, tmp_path):
    files = Arrivals(spark, tmp_path, CHANGES)
    settings = {"wait": 10, "interval": 60, "repeat": 600}
    make = lambda s: alerts.notices(s, ["service"], late="1 hour", **settings)
    for part in shuffled(changes(4), 5, 2):
        files.arrive(part)
        files.run(make)
    files.arrive([(-1, 0, "info", "pending", START + timedelta(days=2))])
    got = files.run(make)
    until = int((START + timedelta(days=2) - timedelta(hours=2) - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    want = telemetry.notices(files.all(), ["service"], until=until, **settings)
    rows = same(got, want, until)
    assert any(r[0] for r in rows) and not all(r[0] for r in rows)  # some come again


def plain_traces(rows, wait, most):
    held, out = {}, []
    for trace, ts in sorted(rows, key=lambda r: r[1]):
        for name in [n for n, (b, _) in held.items() if b + wait < ts]:
            out.append((name, *held.pop(name), "waited"))
        if trace not in held and len(held) >= most:
            name = next(iter(held))
            out.append((name, *held.pop(name), "full"))
        b, n = held.get(trace, (ts, 0))
        held[trace] = (b, n + 1)
    return out + [(n, b, k, "waited") for n, (b, k) in held.items()]


@pytest.mark.parametrize("most", [1000, 3])
def test_traces(spark, tmp_path, most):
    pick = random.Random(most)
    times = pick.sample(range(2000), 300)
    rows = [(pick.choice([None, 1, 2, 3, 4, 5, 6]), START + timedelta(seconds=t)) for t in times]
    files = Arrivals(spark, tmp_path, "trace long, ts timestamp")
    make = lambda s: alerts.grouped_traces(s, "trace", wait_seconds=10, most=most, late="1 hour")
    for part in shuffled(rows, 6, 2):
        files.arrive(part)
        files.run(make)
    files.arrive([(99, END)])
    got = [(r.trace, START + timedelta(microseconds=r.begun - int((START - datetime(1970, 1, 1)).total_seconds()) * 1_000_000), r.spans, r.reason) for r in files.run(make).where("trace IS NULL OR trace != 99").collect()]
    want = plain_traces(rows, timedelta(seconds=10), most)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert ("full" in {r[-1] for r in got}) == (most == 3)


def test_progress_and_settled(spark, tmp_path):
    rows = [(k % 3, "parse" if k % 2 else "embed", START + timedelta(seconds=k)) for k in range(60)]
    files = Arrivals(spark, tmp_path / "p", "index long, stage string, ts timestamp")
    for part in shuffled(rows, 7, 3):
        files.arrive(part)
        got = files.run(lambda s: alerts.progress(s, ["index", "stage"], late="1 day"))
    assert sorted((r["index"], r["stage"]) for r in got.collect()) == sorted({r[:2] for r in rows})

    burst = [("f", START + timedelta(seconds=s)) for s in (0, 1, 2, 100, 101, 300)] + [(None, START)]
    files = Arrivals(spark, tmp_path / "s", "path string, ts timestamp")
    for part in shuffled(burst, 8, 2):
        files.arrive(part)
    files.arrive([("end", END)])
    got = files.run(lambda s: alerts.settled(s, "path", gap="10 seconds", late="1 hour"))
    assert sorted(r.changes for r in got.where("path = 'f'").collect()) == [1, 2, 3]


def test_late_rows_are_refused(spark, tmp_path):
    files = Arrivals(spark, tmp_path, "service string, value double, ts timestamp")
    make = lambda s: alerts.transitions(s, ["service"], F.col("value") > 1, 0, late="1 minute")
    files.arrive([("a", 5.0, START + timedelta(hours=1))])
    files.run(make)
    files.arrive([("a", 0.0, START + timedelta(hours=3))])
    files.run(make)
    files.arrive([("a", 0.0, START)])
    files.arrive([("end", 0.0, END)])
    got = files.run(make).where("service = 'a'").collect()
    assert sorted(r.state for r in got) == ["firing", "pending", "resolved"]


def test_empty(spark):
    none = spark.createDataFrame([], CHANGES)
    assert telemetry.transitions(none, ["service"], F.col("id") > 1, 5).collect() == []
    assert telemetry.inhibited_changes(none, ["service"]).collect() == []
    assert telemetry.notices(none, ["service"], until=LAST).collect() == []


def test_metrics_read(spark, tmp_path):
    spark.range(3).withColumn("ts", F.current_timestamp()).write.parquet(f"{tmp_path}/in")
    assert metrics.read_events(spark, f"{tmp_path}/in", "id long, ts timestamp").isStreaming


def test_kept_table_removes_and_expires(spark, tmp_path):
    schema = "path string, version long, ts timestamp, gone boolean"
    hour = lambda h: START + timedelta(hours=h)
    files = Arrivals(spark, tmp_path, schema)
    table = f"{tmp_path}/table"

    def run(**settings):
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{files.folder}/in/*")
        metrics.upsert_latest(rows, table, f"{tmp_path}/kept", "path", "version", buckets=4, **settings).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.path, r.version) for r in metrics.read_latest(spark, table, schema, gone="gone").collect())

    assert metrics.expire(spark, table, schema, "path", F.lit(True), buckets=4) == 0
    files.arrive([("a", 1, hour(0), False), ("b", 1, hour(0), None), ("c", 1, hour(1), False)])
    assert run() == [("a", 1), ("b", 1), ("c", 1)]
    files.arrive([("a", 3, hour(2), True)])
    assert run() == [("b", 1), ("c", 1)]
    # an older row does not bring a removed file back, a newer one does
    files.arrive([("a", 2, hour(3), False)])
    assert run() == [("b", 1), ("c", 1)]
    files.arrive([("a", 4, hour(4), False)])
    assert run() == [("a", 4), ("b", 1), ("c", 1)]
    assert metrics.expire(spark, table, schema, "path", F.col("ts") < hour(1), buckets=4) == 1
    assert sorted(r.path for r in metrics.read_latest(spark, table, schema).collect()) == ["a", "c"]
    assert metrics.expire(spark, table, schema, "path", F.lit(True), buckets=4) == 2
    assert metrics.read_latest(spark, table, schema).collect() == []
    files.arrive([("d", 1, hour(9), False), ("e", 1, hour(5), False)])
    assert run(retain=("ts", 3600)) == [("d", 1)]
