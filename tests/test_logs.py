"""Stages of log lines, series of one or the other, readings and bands."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from skein.operators import logs


def test_stages(spark):
    came = datetime(2024, 5, 1)
    lines = [
        '{"log": "a\\n", "stream": "stdout", "attrs": {"tag": "web|1|x"}, "time": "2024-01-02T03:04:05.123456789Z"}',
        '{"log": "b", "stream": null, "attrs": {"tag": "no bar"}, "time": "never"}',
        '{"stream": "stdout"}',
        "plain",
        "[1]",
        "",
        None,
    ]
    rows = logs.staged(spark.createDataFrame([(k, t, came) for k, t in enumerate(lines)], "id int, line string, came timestamp")).orderBy("id").collect()
    assert [(r.output, r.labels) for r in rows] == [("a\n", {"stream": "stdout", "container_name": "web"}), ("b", {}), *[(t, {}) for t in lines[2:6]]]
    assert rows[0]["at"] == datetime(2024, 1, 2, 3, 4, 5, 123456) and {r["at"] for r in rows[1:]} == {came}


def test_either_and_readings(spark):
    series = lambda *rows: spark.createDataFrame(list(rows), "k string, value double")
    out = logs.either(series(("a", 1.0), (None, 2.0)), series(("a", 3.0), ("b", 4.0), (None, 5.0)), ["k"])
    assert sorted(map(str, out.collect())) == sorted(map(str, series(("a", 1.0), (None, 2.0), ("b", 4.0)).collect()))
    samples = spark.createDataFrame([("a", 1, 5.0), ("a", 2, None), ("b", 1, None), ("a", 0, 7.0)], "k string, at int, value double")
    assert [tuple(r) for r in logs.last_readings(samples, ["k"], ["at"]).collect()] == [("a", 5.0, 6.0, 2)]
    steps = [(None, "green"), (50, "red"), (10, "yellow")]
    got = spark.createDataFrame([(x,) for x in (None, -1.0, 10.0, 49.9, 50.0)], "v double").select(logs.band(F.col("v"), steps).alias("b"))
    assert [r.b for r in got.collect()] == [None, "green", "yellow", "yellow", "red"]
