"""The folder that the whole cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    A local session that names none gets a temporary one; on a cluster that is an error, as its machines
    could not see one another's files. Spark reports a placeholder where the setting is absent, so the
    session's explicit configuration is asked first.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="skein-"))
    return "file://" + _local[0]
