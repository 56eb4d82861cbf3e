"""Parts under a manifest: round trips, appends, failed tasks, damage."""

from __future__ import annotations

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from skein.sources import artifacts


def names(path):
    return {p.name for p in Path(path).iterdir()}


def files_of(spark, n, first=0):
    return spark.range(first, first + n).repartition(3).select(F.concat(F.lit("d/é"), "id").alias("name"), F.encode(F.repeat(F.col("id").cast("string"), 50), "UTF-8").alias("content"))


def rows(df):
    return sorted((r[0], bytes(r[1])) for r in df.collect())


def test_bundle(spark, tmp_path):
    path = f"{tmp_path}/b"
    artifacts.write_parts(files_of(spark, 60).withColumn("extra", F.lit(1)), artifacts.BundleParts, path, part_bytes=500)
    back = artifacts.read_parts(spark, artifacts.BundleParts, path)
    assert rows(back) == rows(files_of(spark, 60))
    told = artifacts.read_manifest(path)
    assert told["rows"] == 60 and len(told["parts"]) > 6 and all(p["size"] <= 500 for p in told["parts"])
    assert names(path) == {artifacts.MANIFEST} | {n for p in told["parts"] for n in p["files"]}
    # more parts, then others in their place
    artifacts.write_parts(files_of(spark, 5, 60), artifacts.BundleParts, f"file://{path}", mode="append")
    assert rows(artifacts.read_parts(spark, artifacts.BundleParts, path)) == rows(files_of(spark, 65))
    artifacts.write_parts(files_of(spark, 2), artifacts.BundleParts, path)
    assert rows(artifacts.read_parts(spark, artifacts.BundleParts, path)) == rows(files_of(spark, 2))
    assert len(names(path)) == 1 + len(artifacts.read_manifest(path)["parts"])


def test_failed_tasks_leave_nothing(spark, tmp_path):
    path = f"{tmp_path}/b"
    artifacts.write_parts(files_of(spark, 20), artifacts.BundleParts, path)
    before = names(path)
    broken = files_of(spark, 40).withColumn("content", F.when(F.col("name") != "d/é7", F.col("content")))
    with pytest.raises(Exception, match="no nulls"):
        artifacts.write_parts(broken, artifacts.BundleParts, path, part_bytes=200)
    assert names(path) == before
    assert rows(artifacts.read_parts(spark, artifacts.BundleParts, path)) == rows(files_of(spark, 20))


def test_vectors(spark, tmp_path):
    path = f"{tmp_path}/v"
    df = spark.range(500).select(F.to_json(F.struct(F.concat(F.lit('"\n é'), "id").alias("chunk_id"), "id")).alias("chunk"), F.array(*[(F.col("id") / k).cast("float") for k in (1, 3, 7)]).alias("embedding"))
    artifacts.write_parts(df, artifacts.VectorParts, path, part_bytes=3000)
    key = lambda f: sorted((r.chunk, tuple(r.embedding)) for r in f.collect())
    back = artifacts.read_parts(spark, artifacts.VectorParts, path)
    assert key(back) == key(df)
    part = artifacts.read_manifest(path)["parts"][0]
    data = next(Path(path, n).read_bytes() for n in part["files"] if n.endswith(".bin"))
    assert int.from_bytes(data[:4], "little") == part["rows"] and int.from_bytes(data[4:8], "little") == 3 and len(data) == 8 + 12 * part["rows"]


def test_damage_is_told(spark, tmp_path):
    path = f"{tmp_path}/b"
    artifacts.write_parts(files_of(spark, 3), artifacts.BundleParts, path)
    name = next(iter(artifacts.read_manifest(path)["parts"][0]["files"]))
    data = bytearray(Path(path, name).read_bytes())
    data[len(data) // 2] ^= 1
    Path(path, name).write_bytes(data)
    with pytest.raises(Exception, match="not what its manifest says"):
        artifacts.read_parts(spark, artifacts.BundleParts, path).collect()


def test_empty(spark, tmp_path):
    path = f"{tmp_path}/none"
    artifacts.write_parts(files_of(spark, 0), artifacts.BundleParts, path)
    assert artifacts.read_parts(spark, artifacts.BundleParts, path).collect() == []
    os.makedirs(f"{tmp_path}/unwritten")
    assert artifacts.read_parts(spark, artifacts.VectorParts, f"{tmp_path}/unwritten").collect() == []


def test_many_small_parts_are_read_by_few_tasks(spark, tmp_path, monkeypatch):
    """A task for each part, and a batch for each file, cost more than what is in them."""
    path = f"{tmp_path}/b"
    artifacts.write_parts(files_of(spark, 300), artifacts.BundleParts, path, part_bytes=500)
    back = artifacts.read_parts(spark, artifacts.BundleParts, path)
    assert len(artifacts.read_manifest(path)["parts"]) > 60 and back.rdd.getNumPartitions() == 1
    assert rows(back) == rows(files_of(spark, 300))
    reader = artifacts.PartsReader(artifacts._Bundle(), path)
    monkeypatch.setattr(artifacts, "READ_BYTES", 5_000)
    dealt = reader.partitions()
    assert len(dealt) > 5 and all(sum(p.size for p in d.parts) <= 5_000 for d in dealt)
    assert all(b.num_rows > 1 for b in reader.read(dealt[0])) and sum(b.num_rows for d in dealt for b in reader.read(d)) == 300
    monkeypatch.setattr(artifacts, "BATCH_BYTES", 10)
    assert {b.num_rows for b in reader.read(dealt[0])} == {1}
