"""Registered queries over graphs of code, names and packages, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import answers, fuzzy_index, graph, symbols, workspaces
from skein.plans.queries import _CALLS_SQL, _SYMBOLS_SQL, PART_CODE_SQL, _table, query
from skein.sources.code_view import part_code

#: Documents as files that depend on one another: on one that their length and number give, and two of three on another.
_DEPENDS_SQL = """WITH RECURSIVE n AS (SELECT max(doc_id) + 1 AS n FROM documents),
e AS (SELECT doc_id AS source, (n_chars * 7 + doc_id) % n AS target FROM documents, n UNION SELECT doc_id, (n_chars * 13 + doc_id * 5) % n FROM documents, n WHERE doc_id % 3 > 0),
reach AS (SELECT source, target FROM e UNION SELECT r.source, e.target FROM reach r JOIN e ON r.target = e.source),
v AS (SELECT source AS node FROM e UNION SELECT target FROM e),
mutual AS (SELECT a.source AS node, a.target AS other FROM reach a JOIN reach b ON a.source = b.target AND a.target = b.source UNION SELECT node, node FROM v),
c AS (SELECT node, min(other) AS component, count(*) AS size FROM mutual GROUP BY node)"""


def _depends(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    n = docs.agg(F.max("doc_id") + 1).first()[0] or 1
    first = docs.select(F.col("doc_id").alias("source"), ((F.col("n_chars") * 7 + F.col("doc_id")) % n).alias("target"))
    return first.unionByName(docs.where("doc_id % 3 > 0").select(F.col("doc_id").alias("source"), ((F.col("n_chars") * 13 + F.col("doc_id") * 5) % n).alias("target")))


@query(f"{_DEPENDS_SQL} SELECT node, component, size FROM c")
def strong_components(spark, sf_dir):
    return graph.strong_components(_depends(spark, sf_dir))


@query(
    f"""{_DEPENDS_SQL} SELECT component, max(size) AS size, string_agg(node, ',' ORDER BY node) AS nodes FROM c
WHERE size > 1 OR node IN (SELECT source FROM e WHERE source = target) GROUP BY component"""
)
def circular_dependencies(spark, sf_dir):
    return graph.circles(_depends(spark, sf_dir)).select("component", "size", F.array_join(F.col("nodes").cast("array<string>"), ",").alias("nodes"))


_EDITS = 2
_NAMES_SQL = f"{PART_CODE_SQL}, {_CALLS_SQL.split(', marked AS')[0]}, names AS (SELECT DISTINCT lower(symbol) AS name FROM ({_SYMBOLS_SQL}) WHERE kind = 'function')"


@query(
    f"""{_NAMES_SQL}, a AS (SELECT DISTINCT left(name, 2) || substr(name, 4) AS asked FROM names)
SELECT asked, name, CAST(levenshtein(asked, name) AS INTEGER) AS distance FROM a, names WHERE levenshtein(asked, name) <= {_EDITS}"""
)
def fuzzy_symbols(spark, sf_dir):
    """Names of functions for names with their third character left out."""
    found = symbols.extract_symbols(symbols.line_table(part_code(spark, sf_dir))).where("kind = 'function'")
    names = graph.cut(found.select(F.col("symbol").alias("name")).distinct())
    asked = names.select(F.concat(F.substring("name", 1, 2), F.expr("substring(name, 4)")).alias("asked"))
    return fuzzy_index.lookup(fuzzy_index.index(names, _EDITS), asked, _EDITS)


_FOLDER = "CASE WHEN doc_id % 11 = 0 THEN '' ELSE lang || '/' END || source || '/m' || doc_id % 3 || '/'"
_TREE_SQL = f"""WITH f AS (SELECT {_FOLDER} || CASE WHEN doc_id % 40 = 0 THEN 'package.json' WHEN doc_id % 37 = 0 THEN '../pyproject.toml' ELSE 'f' || doc_id || '.ts' END AS path, n_chars AS size FROM documents),
p AS (SELECT DISTINCT replace(path, 'm0/../', '') AS path, size FROM f WHERE path NOT LIKE '%m1/../%' AND path NOT LIKE '%m2/../%'),
r AS (SELECT DISTINCT regexp_replace(path, '/?[^/]*$', '') AS root FROM p WHERE path LIKE '%/package.json' OR path LIKE '%/pyproject.toml'),
w AS (SELECT p.path, p.size, coalesce(arg_max(r.root, length(r.root)), '') AS root FROM p LEFT JOIN r ON starts_with(p.path, r.root || '/') GROUP BY 1, 2)"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of modules, some of which hold a package's marker, as do some folders of sources."""
    i = F.col("doc_id")
    folder = F.concat(F.when(i % 11 == 0, "").otherwise(F.concat("lang", F.lit("/"))), "source", F.lit("/m"), i % 3, F.lit("/"))
    name = F.when(i % 40 == 0, "package.json").when(i % 37 == 0, "../pyproject.toml").otherwise(F.concat(F.lit("f"), i, F.lit(".ts")))
    path = F.concat(folder, name)
    files = _table(spark, sf_dir, "documents").select(path.alias("path"), F.col("n_chars").alias("size")).where(~F.col("path").rlike("m[12]/\\.\\./"))
    return files.withColumn("path", F.replace("path", F.lit("m0/../"), F.lit(""))).distinct()


@query(f"{_TREE_SQL} SELECT path, size, root FROM w")
def workspace_files(spark, sf_dir):
    files = _files(spark, sf_dir)
    return workspaces.assigned(files, workspaces.roots(files)).select("path", "size", "root")


@query(f"{_TREE_SQL} SELECT root, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, count(DISTINCT regexp_extract(path, '\\.([^./]*)$', 1)) AS kinds FROM w GROUP BY root")
def workspace_totals(spark, sf_dir):
    files = _files(spark, sf_dir)
    return workspaces.totals(workspaces.assigned(files, workspaces.roots(files)))


_ASKED = "What is called by GET_ECONOMY and helper_7?"


@query(
    f"""{PART_CODE_SQL}, {_CALLS_SQL}, d AS (SELECT path, symbol, min(line_no) AS line_no FROM ({_SYMBOLS_SQL}) WHERE type = 'def' GROUP BY 1, 2),
k AS (SELECT DISTINCT path, caller, callee, first_line FROM edges WHERE callee IS NOT NULL),
s0 AS (SELECT path, symbol, 0 AS depth, symbol AS way, NULL AS parent FROM d WHERE lower(symbol) IN ('what', 'is', 'called', 'by', 'get_economy', 'and', 'helper_7')),
s1 AS (SELECT k.path, k.callee AS symbol, 1 AS depth, min_by(s.way || ' -> ' || k.callee, k.caller) AS way, min(k.caller) AS parent FROM k JOIN s0 s ON k.path = s.path AND k.caller = s.symbol WHERE (k.path, k.callee) NOT IN (SELECT path, symbol FROM s0) GROUP BY 1, 2),
s2 AS (SELECT k.path, k.callee AS symbol, 2 AS depth, min_by(s.way || ' -> ' || k.callee, k.caller) AS way, min(k.caller) AS parent FROM k JOIN s1 s ON k.path = s.path AND k.caller = s.symbol WHERE (k.path, k.callee) NOT IN (SELECT path, symbol FROM s0 UNION SELECT path, symbol FROM s1) GROUP BY 1, 2),
f AS (FROM s0 UNION ALL FROM s1 UNION ALL FROM s2),
b AS (SELECT f.*, coalesce(d.line_no, k.first_line) AS line_no FROM f LEFT JOIN d USING (path, symbol) LEFT JOIN k ON k.path = f.path AND k.caller = f.parent AND k.callee = f.symbol),
o AS (SELECT path, line_no, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM lines),
t AS (SELECT row_number() OVER (ORDER BY depth, way, path, line_no) AS ord, * FROM b ORDER BY depth, way, path, line_no LIMIT 50)
SELECT CAST(ord AS INTEGER) AS ord, 'callgraph' AS intent, t.symbol, t.depth, t.way, t.path, CAST(t.line_no AS INTEGER) AS line_no, CAST(l.start AS BIGINT) AS start, CAST(l.start + length(l.line) AS BIGINT) AS "end",
  array_to_string(string_split(c.content, chr(10))[greatest(t.line_no - 2, 0) + 1 : t.line_no + 3], chr(10)) AS snippet, sha256(c.content) AS content_sha
FROM t JOIN o l ON l.path = t.path AND l.line_no = t.line_no JOIN code c ON c.path = t.path"""
)
def graph_answer(spark, sf_dir):
    """The fifty nearest pieces of evidence for a question about calls."""
    return answers.ask(_ASKED, part_code(spark, sf_dir), k=50)


@query(
    f"""{PART_CODE_SQL}, {_CALLS_SQL.split(", calls AS (")[0]}, calls AS (
  SELECT path, caller, occurrence, line_no, unnest(found) AS callee, unnest(range(len(found))) AS nth FROM (SELECT *, regexp_extract_all(line, '(\\w+)\\s*\\(', 1) AS found FROM carried WHERE defined IS NULL AND caller IS NOT NULL)
), firsts AS (SELECT path, caller, callee, min(line_no * 1000000 + nth) AS first FROM calls JOIN heads USING (path, caller, occurrence) WHERE callee <> caller GROUP BY 1, 2, 3)
SELECT path, caller, callee, CAST(row_number() OVER (PARTITION BY path, caller ORDER BY first) AS INTEGER) AS ord FROM firsts"""
)
def call_order(spark, sf_dir):
    """Callees of each function in the order in which they come, within a line too."""
    return symbols.call_edges(symbols.line_table(part_code(spark, sf_dir))).where("callee IS NOT NULL").select("path", "caller", "callee", "ord")
