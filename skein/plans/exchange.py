"""Registered queries that write artifacts and read them back, each with the SQL of what has to be in them."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from skein.operators import symbols
from skein.plans.queries import _LINES_SQL, _SYMBOLS_SQL, PART_CODE_SQL, _table, query
from skein.sources import artifacts
from skein.sources.code_view import part_code
from skein.sources.shared import shared_folder


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/skein-{name}-{uuid.uuid4().hex}"


@query("SELECT vec_id, label, CAST(len(embedding) AS INTEGER) AS dimensions, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings")
def vector_parts(spark, sf_dir):
    """Embeddings written as vector files with a line of JSON for each, and read back."""
    path = _place(spark, "vectors")
    rows = _table(spark, sf_dir, "embeddings").select(F.to_json(F.struct("vec_id", "label")).alias("chunk"), "embedding")
    artifacts.write_parts(rows, artifacts.VectorParts, path, part_bytes=64_000)
    back = artifacts.read_parts(spark, artifacts.VectorParts, path)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    chunk = F.from_json("chunk", "vec_id long, label int")
    return back.select(chunk["vec_id"].alias("vec_id"), chunk["label"].alias("label"), F.size("embedding").alias("dimensions"), F.round(total, 6).alias("total"))


@query(f"{PART_CODE_SQL} SELECT path AS name, CAST(strlen(content) AS INTEGER) AS bytes, sha256(content) AS sha FROM code")
def bundle_parts(spark, sf_dir):
    """Source files bundled as compressed archives of a few kilobytes each, and read back."""
    path = _place(spark, "bundle")
    rows = part_code(spark, sf_dir).select(F.col("path").alias("name"), F.encode("content", "UTF-8").alias("content"))
    artifacts.write_parts(rows, artifacts.BundleParts, path, part_bytes=50_000)
    return artifacts.read_parts(spark, artifacts.BundleParts, path).select("name", F.octet_length("content").alias("bytes"), F.sha2("content", 256).alias("sha"))


@query(f"""{PART_CODE_SQL}, {_LINES_SQL}, found AS ({_SYMBOLS_SQL}) SELECT path, symbol, kind, type, start, "end" FROM found""")
def symbol_lines(spark, sf_dir):
    """Symbols written as lines of JSON and read back."""
    path = _place(spark, "symbols")
    found = symbols.extract_symbols(symbols.line_table(part_code(spark, sf_dir))).select("path", "symbol", "kind", "type", "start", "end")
    artifacts.write_lines(found, path)
    return spark.read.schema(found.schema).json(path)
