"""Binary vector files: two unsigned 32-bit counts (vectors, dimensions), then 32-bit floats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_vector_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, ordinal, embedding) of every vector; a file whose size does not fit its header gives none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                if len(content) < 8:
                    continue
                n, dimension = (int(x) for x in np.frombuffer(content[:8], dtype="<u4"))
                if dimension == 0 or len(content) != 8 + 4 * n * dimension:
                    continue
                values = pa.array(np.frombuffer(content[8:], dtype="<f4"))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * dimension + 1, dimension), pa.int32()), values)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(n)), lists], names=["path", "ordinal", "embedding"])

    return files.mapInArrow(parse, "path string, ordinal long, embedding array<float>")


def encode_vectors(vectors: DataFrame, key: str, order: str) -> DataFrame:
    """(key, content): one file's bytes for each value of ``key``; groups are as large as a file may be."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        rows = np.asarray(table["embedding"].to_pylist(), dtype="<f4")
        head = np.array([len(rows), rows.shape[1] if rows.ndim == 2 else 0], dtype="<u4")
        return pa.table({key: table[key].slice(0, 1), "content": pa.array([head.tobytes() + rows.tobytes()], pa.binary())})

    kind = dict(vectors.dtypes)[key]
    return vectors.groupBy(key).applyInArrow(pack, f"{key} {kind}, content binary")


def manifest(files: DataFrame, symbols: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row of counts over an index's tables."""
    f = files.agg(F.count("*").alias("files_total"))
    s = symbols.agg(F.count_if(F.col("type") == "def").alias("symbols_defs"), F.count_if(F.col("type") == "ref").alias("symbols_refs"), F.count_distinct("path").alias("files_indexed"))
    v = vectors.agg(F.count("*").alias("vectors"))
    return f.crossJoin(s).crossJoin(v)  # one row each
