"""Chunks of texts: by lines, and by overlapping runs of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.text import trimmed


def line_chunks(files: DataFrame, chunk_size: int = 400, least_chars: int = 50) -> DataFrame:
    """(path, first_line, chunk): runs of ``chunk_size // 10`` lines; short ones are left out."""
    step = max(1, chunk_size // 10)
    lines = F.split("content", "\n", -1)
    # slices are made inside the row, so no chunk carries the whole text
    pieces = F.transform(F.sequence(F.lit(0), F.size("lines") - 1, F.lit(step)), lambda at: F.struct(at.alias("first_line"), F.array_join(F.slice("lines", at + 1, F.lit(step)), "\n").alias("chunk")))
    cut = files.select("path", lines.alias("lines")).select("path", F.explode(pieces).alias("p")).select("path", "p.first_line", "p.chunk")
    return cut.where(F.length(trimmed(F.col("chunk"))) >= least_chars)


def token_chunks(texts: DataFrame, size: int = 400, overlap: int = 64) -> DataFrame:
    """(doc_id, chunk_no, n_tokens, chunk) of white-space tokens; each chunk repeats the last ``overlap``."""
    step = size - overlap
    tokens = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda t: t != "")
    cut = texts.select("doc_id", tokens.alias("tokens")).where(F.size("tokens") > 0)
    firsts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("tokens") - overlap), F.lit(step))

    def piece(first):
        part = F.slice("tokens", first, F.lit(size))
        return F.struct(F.size(part).alias("n_tokens"), F.array_join(part, " ").alias("chunk"))

    return cut.select("doc_id", F.posexplode(F.transform(firsts, piece)).alias("chunk_no", "p")).select("doc_id", "chunk_no", "p.n_tokens", "p.chunk")
