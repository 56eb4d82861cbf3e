"""From raw documents to packed training sequences: five operators, one after another.

Every stage takes all documents that the stage before it kept and writes its result as a table, which
the next one reads. All but the last return the columns of ``documents``, whatever their number and names.

Defined results of all stages: null and empty texts are documents like others, and clean ones, so only packing
sees their end; rows without ``doc_id`` are judged by their text; rows that share a ``doc_id`` are judged each by
its own text, except that near duplicates keeps or drops them by their id; fully equal rows stay as many as they are
but for near duplicates, which keeps one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.decontaminate import clean_documents
from skein.llm.line_dedup import dedup_lines
from skein.llm.minhash import one_of_each_group
from skein.llm.packing import pack
from skein.llm.storage import saved
from skein.llm.toxicity import reject_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject; it learns from the labelled ones among them.

    Without any label nothing is rejected.
    """
    return reject_toxic(docs, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier line repeats, up to one edit of a character or a word; ``n_chars`` counts what is left.

    A document whose lines all go stays with an empty text; a null text stays null.
    """
    kept = dedup_lines(docs, word_edits=1, counts=False)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id: five-word shingles, a similarity of 0.8 or more.

    Documents without words are in no group and all stay, but for fully equal rows.
    """
    return one_of_each_group(docs, shingle_words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found; without items all stay."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2,048 tokens, best filled first; a text without tokens is a piece of one separator."""
    return pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The stages learn, tokenise and pack, which SQL does not express. ``tests/llm/test_pipeline.py`` holds each stage's
#: rows against a plain version on what the stage before it kept, and the classifier against held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = saved(docs, name)
    return docs
