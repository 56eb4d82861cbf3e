"""Token-ID output: Parquet list columns laid out for selective token and metadata reads.

Documents are dealt by ranges of ``doc_id`` and sorted, so the files hold them in ascending order.
Token ids are dictionary encoded (their values repeat), the ascending metadata columns are delta
encoded (Parquet's version-2 pages), row groups and pages have fixed sizes, and page indexes let a
reader fetch the pages of a few documents, or the metadata without any token page.

A document's place in the whole token stream is the sum of two columns: ``start_in_part``, written
with its tokens, and the place of its part, in a table with one row for each part.

Defined results: a null text counts as empty and gives only the end id; rows with a null ``doc_id``
come first; rows that share a ``doc_id`` are all kept, ordered by their text; an empty table gives an
empty store; further columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm import tokens
from skein.llm.storage import new_path

END_ID = 2
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
STORED = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"


def write_token_store(
    docs: DataFrame,
    path: str,
    *,
    vocabulary: str | None = None,
    end_id: int = END_ID,
    parts: int | None = None,
    row_group_bytes: int = ROW_GROUP_BYTES,
    page_bytes: int = PAGE_BYTES,
) -> None:
    """Tokenise ``docs(doc_id, text)`` and write the store at ``path``: ``tokens/`` and ``parts/``."""
    spark = docs.sparkSession
    vocabulary = vocabulary or tokens.vocabulary_path()
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
        .repartitionByRange(parts, "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .withColumn("part", F.spark_partition_id())
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, start = tokens.encoder(vocabulary), 0
        for batch in batches:
            for lo, hi, ids, ends in encoder.encode(batch["text"]):
                sizes = np.diff(ends) + 1
                bounds = np.append(0, np.cumsum(sizes))
                ids = np.insert(ids, ends[1:], end_id)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(lo, hi - lo),
                        batch["part"].slice(lo, hi - lo),
                        pa.array(start + bounds[:-1]),
                        pa.array(sizes),
                        pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())),
                    ],
                    names=["doc_id", "part", "start_in_part", "n_tokens", "ids"],
                )
                start += int(bounds[-1])

    writer = ordered.mapInArrow(encode, STORED).write.option("compression", "zstd").option("parquet.writer.version", "v2")
    writer = writer.option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes)
    for column in ("doc_id", "part", "start_in_part", "n_tokens"):
        writer = writer.option(f"parquet.enable.dictionary#{column}", "false")
    writer.parquet(f"{path}/tokens")
    sizes = spark.read.schema(STORED).parquet(f"{path}/tokens").groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each part, however many documents there are
    sizes.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).coalesce(1).write.parquet(f"{path}/parts")


def read_token_store(spark: SparkSession, path: str, *columns: str | Column) -> DataFrame:
    """The store's documents with their place ``start``; only the columns asked for are read."""
    stored = spark.read.schema(STORED).parquet(f"{path}/tokens")
    places = spark.read.parquet(f"{path}/parts").select("part", F.col("start").alias("part_start"))
    joined = stored.join(F.broadcast(places), "part")  # as many rows as the writer had tasks
    joined = joined.withColumn("start", F.col("part_start") + F.col("start_in_part"))
    return joined.select(*columns) if columns else joined.select("doc_id", "start", "n_tokens", "ids")


def with_checksum(stored: DataFrame) -> DataFrame:
    """Replace ``ids`` by the unsigned CRC-32 of the ids as little-endian 32-bit integers."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["ids"]
            bounds = ids.offsets.to_numpy()
            data = memoryview(np.ascontiguousarray(ids.values.to_numpy(), dtype="<u4")).cast("B")
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["start"], batch["n_tokens"], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return stored.select("doc_id", "start", "n_tokens", "ids").mapInArrow(sums, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = new_path(spark, "tokens")
    write_token_store(docs, path)
    return with_checksum(read_token_store(spark, path))
