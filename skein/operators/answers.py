"""Questions about code: what is meant, where it begins in the call graph, and what proves the answer."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.text import question_intent
from skein.operators import graph, symbols

#: Hops over the call graph by intent; other intents stay at their seeds.
HOPS = {"callgraph": 2}
CONTEXT_LINES = 2


def seeds_of(question: str, definitions: DataFrame) -> DataFrame:
    """Definitions whose name is a word of the question, whatever its case."""
    words = sorted({w.lower() for w in re.findall(r"\w+", question, re.ASCII)})
    return definitions.where(F.lower("symbol").isin(words)) if words else definitions.limit(0)


def ask(question: str, files: DataFrame, *, k: int = 20, context_lines: int = CONTEXT_LINES) -> DataFrame:
    """(ord, intent, symbol, depth, way, path, line_no, start, end, snippet, content_sha) for ``files(path, content)``.

    Seeds are the definitions that the question names. For questions about calls, what they call comes too, with the
    shortest way there. Evidence is the definition, else the first call that leads to it, with lines around it. Nearer
    ones come first, then by way and place; ``k`` from 1 to 100 rows, 0 to 20 lines. No name that is defined gives no row.
    """
    spark = files.sparkSession
    k, context_lines = min(100, max(1, k)), min(20, max(0, context_lines))
    intent = spark.range(1).select(question_intent(F.lit(question))).first()[0]
    lines = symbols.line_table(files)
    place = lambda name: F.concat_ws("#", "path", name)
    defined = graph.cut(symbols.extract_symbols(lines).where("type = 'def'").groupBy("path", "symbol").agg(F.min("line_no").alias("line_no")).withColumn("node", place("symbol")))
    calls = symbols.call_edges(lines).where("callee IS NOT NULL")
    edges = graph.cut(calls.select("path", "callee", "first_line", place("caller").alias("source"), place("callee").alias("target")))
    depth = HOPS.get(intent, 0)
    found = graph.shortest_paths(graph.reached_by(edges.select("source", "target"), seeds_of(question, defined).select("node"), depth), depth)
    called = edges.select(F.col("source").alias("parent"), F.col("target").alias("node"), "first_line")
    spots = found.join(defined.select("node", F.col("line_no").alias("defined_at")).hint("merge"), "node", "left").join(called.hint("merge"), ["parent", "node"], "left")
    spots = spots.select(
        "depth",
        F.array_join(F.transform("path", lambda n: F.substring_index(n, "#", -1)), " -> ").alias("way"),
        F.substring_index("node", "#", -1).alias("symbol"),
        F.expr("substring(node, 1, length(node) - length(substring_index(node, '#', -1)) - 1)").alias("path"),
        F.coalesce("defined_at", "first_line").alias("line_no"),
    )
    best = graph.cut(spots.orderBy("depth", "way", "path", "line_no").limit(k))
    # k rows at most, so what is shown is read from the files that they stand in
    files = graph.cut(files.join(F.broadcast(best.select("path").distinct()), "path", "left_semi"))
    lines = symbols.line_table(files)
    around = symbols.context(files, best.select("path", "line_no").distinct(), context_lines).withColumnRenamed("context", "snippet")
    ends = lines.select("path", "line_no", "start", (F.col("start") + symbols.utf16_length(F.col("line"))).alias("end"))
    out = best.join(around, ["path", "line_no"]).join(ends, ["path", "line_no"]).join(files.select("path", F.sha2("content", 256).alias("content_sha")), "path")
    order = F.row_number().over(symbols.Window.orderBy("depth", "way", "path", "line_no"))  # k rows
    return out.select(order.alias("ord"), F.lit(intent).alias("intent"), "symbol", "depth", "way", "path", "line_no", "start", "end", "snippet", "content_sha")
