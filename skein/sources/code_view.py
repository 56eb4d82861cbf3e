"""Source files: scanned from folders, or a deterministic view over the ``part`` table for tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import LANGUAGE_EXTENSIONS, extension, is_excluded

BINARY_SHARE = 0.3
SNIFF_BYTES = 8192


def scan_repository(spark: SparkSession, root: str, *, languages: list[str] | None = None, excludes: list[str] | None = None) -> DataFrame:
    """(path, length, modified, content) of the files below ``root``; unreadable files are passed over.

    Files of other languages are not opened. Paths are relative to ``root``, whatever characters it has.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true")
    allowed = [e for name in languages or [] for e in LANGUAGE_EXTENSIONS.get(name, [name])]
    if allowed:
        files = files.option("pathGlobFilter", "*.{" + ",".join(allowed) + "}")
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    base = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString().rstrip("/") + "/"
    relative = F.expr("path").substr(F.lit(len(base) + 1), F.length("path"))
    out = files.load(root).select(relative.alias("path"), "length", F.col("modificationTime").alias("modified"), "content")
    if allowed:
        out = out.where(extension(F.col("path")).isin(allowed))
    return out.where(~is_excluded(F.col("path"), excludes or []))


def size_of(scan: DataFrame) -> DataFrame:
    """Number and bytes of the scanned files."""
    return scan.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def file_metadata(scan: DataFrame, requested: DataFrame) -> DataFrame:
    """A row for each requested path; those that the scan lacks have ``exists`` false."""
    return requested.join(scan.select("path", "length", "modified", F.lit(True).alias("found")), "path", "left").select("path", F.coalesce("length", F.lit(0)).alias("size"), "modified", F.coalesce("found", F.lit(False)).alias("exists"))


def looks_binary(content):
    """Any NUL, or more than three control bytes in ten, among the first bytes."""
    head = F.hex(F.substring(content, 1, SNIFF_BYTES))
    pairs = F.regexp_replace(head, "(..)", "$1 ")
    total = F.length(head) / 2
    control = F.regexp_count(pairs, F.lit("0[1-8BCEF] |1[0-9A-F] "))
    return (F.regexp_count(pairs, F.lit("00 ")) > 0) | F.coalesce(F.try_divide(control, total) > BINARY_SHARE, F.lit(False))


def decoded(scan: DataFrame) -> DataFrame:
    """Text files with their content as UTF-8."""
    return scan.where(~looks_binary(F.col("content"))).withColumn("content", F.decode("content", "UTF-8"))


def dealt_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``part`` table over many tasks: its file may be one group of rows, which one task reads, and each row becomes a file."""
    return spark.read.parquet(f"{sf_dir}/part.parquet").repartition("p_partkey")


def part_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): one small source file for each part, TypeScript for even keys and Python for odd ones."""
    part = dealt_parts(spark, sf_dir)
    word = F.regexp_replace(F.lower("p_name"), "[^a-z]", "_")
    brand = F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]", "")
    key, kind, size = F.col("p_partkey"), F.lower("p_type"), F.col("p_size")
    ts = F.concat(
        F.lit("import { "), word, F.lit(" } from './"), brand, F.lit("'\nexport class P"), key, F.lit(" {}\nexport function get_"), kind, F.lit("(x) {\n  helper_"), size, F.lit("(x); check(x)\n}\nfunction helper_"), size, F.lit("(y) {\n  log(y); get_"), kind, F.lit("(y)\n}"),
    )
    py = F.concat(
        F.lit("from "), brand, F.lit(" import "), word, F.lit("\nclass P"), key, F.lit(":\n    pass\ndef get_"), kind, F.lit("(x):\n    helper_"), size, F.lit("(x)\n    check(x)\ndef helper_"), size, F.lit("(y):\n    return log(y)"),
    )
    even = key % 2 == 0
    path = F.concat(F.lit("src/"), brand, F.lit("/p"), key, F.when(even, ".ts").otherwise(".py"))
    return part.select(path.alias("path"), F.when(even, ts).otherwise(py).alias("content"))


PART_CODE_SQL = """
WITH named AS (
  SELECT p_partkey AS k, regexp_replace(lower(p_name), '[^a-z]', '_', 'g') AS word, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS brand, lower(p_type) AS kind, p_size AS size FROM part
), code AS (
  SELECT 'src/' || brand || '/p' || k || CASE WHEN k % 2 = 0 THEN '.ts' ELSE '.py' END AS path,
    CASE WHEN k % 2 = 0 THEN
      'import { ' || word || ' } from ''./' || brand || '''' || chr(10) || 'export class P' || k || ' {}' || chr(10) || 'export function get_' || kind || '(x) {' || chr(10) || '  helper_' || size || '(x); check(x)' || chr(10) || '}' || chr(10) || 'function helper_' || size || '(y) {' || chr(10) || '  log(y); get_' || kind || '(y)' || chr(10) || '}'
    ELSE
      'from ' || brand || ' import ' || word || chr(10) || 'class P' || k || ':' || chr(10) || '    pass' || chr(10) || 'def get_' || kind || '(x):' || chr(10) || '    helper_' || size || '(x)' || chr(10) || '    check(x)' || chr(10) || 'def helper_' || size || '(y):' || chr(10) || '    return log(y)'
    END AS content
  FROM named
)"""
