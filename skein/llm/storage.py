"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from skein.sources.shared import shared_folder


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/skein-{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Hadoop's file system API."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scope:
    """Intermediate tables of one operator, which it drops when nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[tuple[str, str]] = []

    def saved(self, df: DataFrame, label: str) -> DataFrame:
        path = new_path(self.spark, label)
        df.write.parquet(path)
        self.paths.append((label, path))
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *labels: str) -> None:
        """Delete the tables with these labels; plans that still read them fail."""
        for label, path in self.paths:
            if label in labels:
                removed(self.spark, path)
        self.paths = [x for x in self.paths if x[0] not in labels]
