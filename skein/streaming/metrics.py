"""Structured Streaming forms of the telemetry operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema: str, *, files_per_batch: int = 16) -> DataFrame:
    """A stream of the Parquet files that arrive in ``folder``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed_means(events: DataFrame, *, width: str = "5 minutes", slide: str | None = None, late: str = "168 hours") -> DataFrame:
    """Mean value and count of each event type in event-time windows; later rows than ``late`` are refused."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    window = F.window("ts", width, slide or width)
    return timed.groupBy("event_type", window.alias("w")).agg(F.avg("value").alias("mean_value"), F.count("*").alias("n")).select("event_type", F.col("w.start").alias("window_start"), "mean_value", "n")


def session_counts(events: DataFrame, *, gap: str = "60 minutes", late: str = "168 hours") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_events")).select("user_id", F.col("w.start").alias("session_start"), "n_events")


#: Parts of a table that ``upsert_latest`` keeps; a batch writes those anew that it has keys of.
BUCKETS = 64


def upsert_latest(stream: DataFrame, path: str, checkpoint: str, key: str, order: str, *, buckets: int = BUCKETS, retain: tuple[str, int] | None = None):
    """Keep the newest row of each ``key`` at ``path``, a table of ``buckets`` parts by hash of the key.

    A batch merges with the parts that it has keys of and writes them under a number of its own; ``manifest/<number>``,
    written last and never changed, then names the number of every part. So readers see whole batches, a batch
    that is run again merges the same rows once more, and a fresh checkpoint goes on with the table that is there.
    What neither of the last two manifests names is deleted.

    A row that says that its key is gone is kept like others, so that an older row that comes later does not bring the
    key back; ``read_latest`` leaves it out. ``retain`` names a time and how many seconds before its latest value in the
    batch rows are kept: rows that are older leave the parts that a batch writes, ``expire`` takes them out of all.
    """

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        keyed = batch.withColumn("_bucket", _bucket(key, buckets)).persist()
        touched = [r[0] for r in keyed.select("_bucket").distinct().collect()]  # ``buckets`` at most
        if touched:
            number, before = _state(spark, path)
            rows = keyed
            old = [f"{path}/data/{before[b]}/_bucket={b}" for b in touched if b in before]
            if old:
                rows = keyed.unionByName(spark.read.schema(batch.schema).parquet(*old).withColumn("_bucket", _bucket(key, buckets)))
            newest = rows.groupBy("_bucket", key).agg(F.max_by(F.struct(*[c for c in batch.columns if c != key]), order).alias("r")).select("_bucket", key, "r.*")
            if retain:
                last = keyed.agg(F.max(retain[0])).first()[0]
                newest = newest if last is None else newest.where(~F.coalesce(F.col(retain[0]) < F.lit(last) - F.expr(f"INTERVAL {int(retain[1])} SECONDS"), F.lit(False)))
            _put(spark, path, number, before, touched, newest.select(*batch.columns, "_bucket"))
        keyed.unpersist()

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _state(spark: SparkSession, path: str) -> tuple[int, dict[int, int]]:
    """(the next number, the number of every part)."""
    known = _numbers(spark, path)
    return (known[-1] + 1, _manifest(spark, path, known[-1])) if known else (0, {})


def _put(spark: SparkSession, path: str, number: int, before: dict[int, int], touched: list[int], rows: DataFrame) -> None:
    """Write parts anew, name them in a manifest, and delete what neither this one nor the last one names."""
    rows.write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/data/{number}")
    # a part that has no row left has no folder
    written = {r[0] for r in spark.read.schema(rows.schema).parquet(f"{path}/data/{number}").select("_bucket").distinct().collect()}
    after = {b: n for b, n in before.items() if b not in touched} | {b: number for b in touched if b in written}
    spark.createDataFrame(sorted(after.items()), "bucket int, number long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/{number}")
    named = set(after.items()) | set(before.items())
    for n in range(number):
        if n < number - 1:
            _delete(spark, f"{path}/manifest/{n}")
        if not any(v == n for _, v in named):
            _delete(spark, f"{path}/data/{n}")


def expire(spark: SparkSession, path: str, schema: str, key: str, older: Column, *, buckets: int = BUCKETS) -> int:
    """Take the rows for which ``older`` is true out of a table that ``upsert_latest`` keeps, while no batch runs; how many went.

    Only parts with such rows are written anew, and readers see all of them go at once.
    """
    number, before = _state(spark, path)
    if not before:
        return 0
    parts = [f"{path}/data/{n}/_bucket={b}" for b, n in sorted(before.items())]
    rows = spark.read.schema(schema).parquet(*parts).withColumn("_bucket", _bucket(key, buckets))
    gone = {r["_bucket"]: r["n"] for r in rows.where(older).groupBy("_bucket").agg(F.count("*").alias("n")).collect()}
    if gone:
        own = spark.read.schema(schema).parquet(*[f"{path}/data/{before[b]}/_bucket={b}" for b in sorted(gone)])
        _put(spark, path, number, before, sorted(gone), own.where(~F.coalesce(older, F.lit(False))).withColumn("_bucket", _bucket(key, buckets)))
    return sum(gone.values())


def read_latest(spark: SparkSession, path: str, schema: str, *, gone: str | None = None) -> DataFrame:
    """The table that ``upsert_latest`` keeps at ``path``, without the keys whose newest row has ``gone`` true; empty before its first batch."""
    _, parts = _state(spark, path)
    if not parts:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*[f"{path}/data/{n}/_bucket={b}" for b, n in sorted(parts.items())])
    return rows.where(~F.coalesce(F.col(gone), F.lit(False))) if gone else rows


def _hadoop(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, path: str) -> None:
    target, files = _hadoop(spark, path)
    files.delete(target, True)


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete manifests, in ascending order."""
    target, files = _hadoop(spark, f"{path}/manifest")
    if not files.exists(target):
        return []
    found = [x.getPath().getName() for x in files.listStatus(target)]
    return sorted(int(n) for n in found if n.isdigit() and files.exists(_hadoop(spark, f"{path}/manifest/{n}/_SUCCESS")[0]))


def _manifest(spark: SparkSession, path: str, number: int) -> dict[int, int]:
    return {r["bucket"]: r["number"] for r in spark.read.schema("bucket int, number long").parquet(f"{path}/manifest/{number}").collect()}


def recorded(series: DataFrame, path: str, checkpoint: str):
    """Write the finished windows of a series to Parquet as they close: a recording rule."""
    return series.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
