"""Lines, symbols, imports and call graphs of source texts, by regular expressions.

Defined results: null texts have no lines, an empty one has an empty line; of several definitions of a name in a file
the last counts for calls; files that share a path are scanned each by its text, and their calls are taken together; empty
tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import utf16_length

#: What each language's lines are matched against.
TS_FUNCTION = r"(?:export\s+)?(?:async\s+)?function\s+(\w+)"
TS_CLASS = r"(?:export\s+)?class\s+(\w+)"
TS_INTERFACE = r"(?:export\s+)?interface\s+(\w+)"
TS_IMPORT = r"""import\s+.*\s+from\s+['"]([^'"]+)['"]"""
PY_FUNCTION = r"def\s+(\w+)\s*\("
PY_CLASS = r"class\s+(\w+)"
PY_IMPORT = r"(?:from\s+(\w+)\s+import|import\s+(\w+))"
CALL = r"(\w+)\s*\("
DEFINITION = r"(?:function|def)\s+(\w+)"


#: Lines whose places are summed up together: sums of so many are made inside a block, and from block to block.
LINE_BLOCK = 128


def line_starts(lines: Column) -> Column:
    """Where each of an array of lines begins in the text, in UTF-16 units; work grows with the lines, not their square."""
    sizes = F.transform(lines, lambda x: (utf16_length(x) + 1).cast("long"))
    zero = lambda start: F.array(start.cast("long"))
    add = lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + x))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / LINE_BLOCK).cast("int")), lambda k: F.slice(sizes, k * LINE_BLOCK + 1, F.lit(LINE_BLOCK)))
    bases = F.aggregate(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + x)), zero(F.lit(0)), add)
    return F.flatten(F.transform(blocks, lambda b, k: F.slice(F.aggregate(b, zero(F.element_at(bases, k + 1)), add), F.lit(1), F.size(b))))


def line_table(files: DataFrame) -> DataFrame:
    """(path, line_no, line, start): lines from 0 and their place in UTF-16 units; no row leaves its task. A null text has no lines."""
    split = files.select("path", F.split("content", "\n", -1).alias("lines"))
    # no array for a null text; a filter, or an array with a name, would be worked out a second time where the files are read
    placed = F.arrays_zip(F.col("lines").alias("line"), line_starts(F.col("lines")).alias("start"))
    return split.select("path", F.posexplode(placed).alias("line_no", "l")).select("path", "line_no", F.col("l.line").alias("line"), F.col("l.start").alias("start"))


def context(files: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``wanted(path, line_no)`` with the ``k`` lines around each."""
    lines = F.split("content", "\n", -1)
    low = F.greatest(F.col("line_no") - k, F.lit(0))
    joined = wanted.join(files.hint("merge"), "path").withColumn("_lines", lines)
    return joined.select("path", "line_no", F.array_join(F.slice("_lines", low + 1, F.col("line_no") + k + 1 - low), "\n").alias("context"))


def _entry(pattern: str, kind: str, role: str, groups: int = 1) -> Column:
    line = F.col("line")
    name = F.regexp_extract(line, pattern, 1)
    if groups == 2:
        name = F.coalesce(F.nullif(name, F.lit("")), F.regexp_extract(line, pattern, 2))
    return F.when(line.rlike(pattern), F.struct(name.alias("symbol"), F.lit(kind).alias("kind"), F.lit(role).alias("type")))


def extract_symbols(lines: DataFrame) -> DataFrame:
    """(path, line_no, symbol, kind, type, start, end) of definitions and imports, in line order."""
    ts = [_entry(TS_FUNCTION, "function", "def"), _entry(TS_CLASS, "class", "def"), _entry(TS_INTERFACE, "interface", "def"), _entry(TS_IMPORT, "import", "ref")]
    py = [_entry(PY_FUNCTION, "function", "def"), _entry(PY_CLASS, "class", "def"), _entry(PY_IMPORT, "import", "ref", 2)]
    dotted = F.regexp_extract("path", r"(\.[^./]*)$", 1)
    found = F.when(dotted.isin(".ts", ".tsx", ".js", ".jsx"), F.array_compact(F.array(*ts))).when(dotted.isin(".py", ".pyi"), F.array_compact(F.array(*py)))
    return lines.select("path", "line_no", "start", (F.col("start") + utf16_length(F.col("line"))).alias("end"), F.explode(found).alias("s")).select("path", "line_no", "s.symbol", "s.kind", "s.type", "start", "end")


def call_edges(lines: DataFrame) -> DataFrame:
    """(path, caller, callee, first_line, ord): callees of each function as they come, the last definition of a name counting.

    Lines that define a function hold no calls of their own; calls of itself do not count; functions
    that call nothing have one row without a callee.
    """
    order, own = Window.partitionBy("path").orderBy("line_no"), Window.partitionBy("path", "caller")
    defined = F.nullif(F.regexp_extract("line", DEFINITION, 1), F.lit(""))
    callees = F.when(defined.isNull(), F.regexp_extract_all("line", F.lit(CALL), 1))
    # all that follows is dealt by path once, without the lines' text
    marked = lines.select("path", "line_no", defined.alias("defined"), callees.alias("callees")).where("defined is not null or size(callees) > 0")
    marked = marked.withColumn("occurrence", F.count("defined").over(order))
    marked = marked.withColumn("caller", F.last("defined", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    marked = marked.where("caller is not null").withColumn("latest", F.max(F.when(F.col("defined").isNotNull(), F.col("occurrence"))).over(own))
    calls = marked.select("path", "caller", "line_no", "occurrence", "latest", "defined", F.posexplode_outer("callees").alias("nth", "callee"))
    calls = calls.where("defined is not null or (path is not null and occurrence = latest and callee != caller)")
    firsts = calls.groupBy("path", "caller", "callee").agg(F.min(F.struct("line_no", "nth")).alias("first"))
    kept = firsts.withColumn("called", F.count("callee").over(own)).where("callee is not null or called = 0")
    place = F.row_number().over(own.orderBy("first"))
    stated = lambda c: F.when(F.col("callee").isNotNull(), c)
    return kept.select("path", "caller", "callee", stated(F.col("first.line_no")).alias("first_line"), stated(place).alias("ord"))


def resolved(symbols: DataFrame) -> DataFrame:
    """References with the definitions of the same name."""
    refs = symbols.where("type = 'ref'").select(F.col("path").alias("ref_path"), "line_no", "symbol")
    return refs.join(symbols.where("type = 'def'").select("symbol", F.col("path").alias("def_path"), "kind").hint("merge"), "symbol")


def resolved_once(symbols: DataFrame) -> DataFrame:
    """Each reference with one definition of its name: that of its own file, else the first by path, and how many there are.

    Definitions are brought together by name before they meet references, so a common name costs a row a reference.
    References without a definition stay, with none.
    """
    refs = symbols.where("type = 'ref'").select(F.col("path").alias("ref_path"), "line_no", "symbol")
    defs = symbols.where("type = 'def'")
    every = defs.groupBy("symbol").agg(F.count_distinct("path").alias("definitions"), F.min("path").alias("first_path"))
    own = defs.select(F.col("path").alias("ref_path"), "symbol", F.col("path").alias("own_path")).distinct()
    # the definitions of a name are one row, and references to it pass it by unsorted, however many they are
    out = refs.join(own.hint("merge"), ["ref_path", "symbol"], "left").join(every.hint("shuffle_hash"), "symbol", "left")
    return out.select("ref_path", "line_no", "symbol", F.coalesce("own_path", "first_path").alias("def_path"), F.coalesce("definitions", F.lit(0)).alias("definitions"))


def symbols_in_spans(symbols: DataFrame, spans: DataFrame) -> DataFrame:
    """Symbols within ``spans(path, span_start, span_end)``: equal paths, then a range."""
    return symbols.join(spans.hint("merge"), "path").where("start >= span_start and end <= span_end")


def fuzzy(symbols: DataFrame, name: str, edits: int) -> DataFrame:
    distance = F.levenshtein(F.lower("symbol"), F.lit(name.lower()), edits)
    return symbols.withColumn("distance", distance).where(F.col("distance") >= 0)
