"""Registered queries over the shared tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import hybrid_score, relevance, whole_word
from skein.functions.vectors import norm
from skein.operators import chunks, discovery, graph, loadouts, research, search, symbols, telemetry
from skein.sources.code_view import PART_CODE_SQL, part_code

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: What the retrieval queries ask.
QUESTION = "with the retitioning"
TOP = 10
PAGERANK_ROUNDS = 4


def query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _first_vector(vectors: DataFrame) -> list[float]:
    return vectors.where(F.col("vec_id") == 0).select("embedding").first()[0]


_COS = "round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)"
_WORDS_SQL = " + ".join(
    f"(CASE WHEN contains(lower(text), '{t}') THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN regexp_matches(lower(text), '\\b{t}\\b') THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END)" for t in QUESTION.split()
)


@query(f"SELECT e.vec_id, {_COS} AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY score DESC, vec_id LIMIT {TOP}")
def vector_topk(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings")
    return search.vector_topk(vectors, _first_vector(vectors), TOP).select("vec_id", "score")


@query(
    f"""SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT q.vec_id AS query_id, e.vec_id, {_COS} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) AS rank
  FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0) WHERE rank <= {TOP}"""
)
def vector_topk_per_query(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    queries = vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    return search.topk_per_query(vectors, queries, TOP)


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm FROM embeddings")
def vector_norms(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.round(norm(F.col("embedding")), 6).alias("norm"))


@query(
    f"""SELECT CAST(CASE WHEN s < -1 THEN 0 WHEN s >= 1 THEN 21 ELSE floor((s + 1) / 0.1::DOUBLE) + 1 END AS BIGINT) AS bucket, count(*) AS n
FROM (SELECT {_COS} AS s FROM embeddings e, embeddings q WHERE q.vec_id = 0) GROUP BY 1"""
)
def score_histogram(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings")
    return search.score_histogram(search.vector_scores(vectors, _first_vector(vectors)), 20)


@query(f"SELECT doc_id, round(least({_WORDS_SQL}, 1.0), 6) AS relevance FROM documents")
def relevance_scores(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.round(relevance(F.col("text"), F.lit("doc.txt"), QUESTION), 6).alias("relevance"))


@query(
    f"""WITH near AS (SELECT e.vec_id, {_COS} AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY score DESC, vec_id LIMIT {3 * TOP})
SELECT doc_id, score AS vector_score, round(least({_WORDS_SQL}, 1.0), 6) AS symbol_score, round(0.4::DOUBLE * score + 0.6::DOUBLE * least({_WORDS_SQL}, 1.0), 6) AS score
FROM near JOIN documents ON vec_id = doc_id ORDER BY 4 DESC, doc_id LIMIT {TOP}"""
)
def hybrid_search(spark, sf_dir):
    """Three times as many candidates as asked for by vector, scored again with their words."""
    vectors = _table(spark, sf_dir, "embeddings")
    near = search.vector_topk(vectors, _first_vector(vectors), 3 * TOP).select(F.col("vec_id").alias("doc_id"), F.col("score").alias("vector_score"))
    found = _table(spark, sf_dir, "documents").select("doc_id", "text").join(F.broadcast(near), "doc_id")  # 3 * TOP rows
    words = relevance(F.col("text"), F.lit("doc.txt"), QUESTION)
    out = found.select("doc_id", "vector_score", F.round(words, 6).alias("symbol_score"), F.round(hybrid_score(F.col("vector_score"), words), 6).alias("score"))
    return out.orderBy(F.desc("score"), "doc_id").limit(TOP)


_RANKED_SQL = "SELECT event_type AS list, user_id AS id, CAST(count(*) AS DOUBLE) AS score FROM events GROUP BY 1, 2"


def _scored_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("list"), F.col("user_id").alias("id")).agg(F.count("*").cast("double").alias("score"))


@query(f"SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS fused, count(*) AS lists FROM (SELECT *, row_number() OVER (PARTITION BY list ORDER BY score DESC, id) AS rank FROM ({_RANKED_SQL})) GROUP BY id")
def rank_fusion(spark, sf_dir):
    return search.reciprocal_rank_fusion(search.ranked_lists(_scored_users(spark, sf_dir)))


@query(f"SELECT id, round(sum(CASE list WHEN 'purchase' THEN 1.0::DOUBLE WHEN 'click' THEN 0.9::DOUBLE WHEN 'view' THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END * score), 6) AS fused FROM ({_RANKED_SQL}) GROUP BY id")
def weighted_fusion(spark, sf_dir):
    return search.weighted_fusion(_scored_users(spark, sf_dir), {"purchase": 1.0, "click": 0.9, "view": 0.3})


@query(
    """SELECT path, start, "end", max(score) AS score FROM (
  SELECT 'o' || l_orderkey AS path, l_linenumber AS start, l_linenumber + 1 AS "end", l_discount AS score FROM lineitem
  UNION ALL SELECT 'o' || l_orderkey, l_linenumber, l_linenumber + 1, l_tax FROM lineitem) GROUP BY 1, 2, 3"""
)
def candidate_union(spark, sf_dir):
    items = _table(spark, sf_dir, "lineitem")
    place = [F.concat(F.lit("o"), "l_orderkey").alias("path"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + 1).alias("end")]
    return search.union_of_candidates(items.select(*place, F.col("l_discount").alias("score")), items.select(*place, F.col("l_tax").alias("score")))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_code(spark, sf_dir).withColumn("size", F.length("content").cast("long"))


@query(PART_CODE_SQL + " SELECT regexp_extract(path, '\\.([^.]*)$', 1) AS ext, count(*) AS files, CAST(sum(length(content)) AS BIGINT) AS bytes FROM code GROUP BY 1")
def file_type_histogram(spark, sf_dir):
    return discovery.type_histogram(_files(spark, sf_dir))


@query(
    PART_CODE_SQL
    + " SELECT count(*) AS total_files, count(*) FILTER (path LIKE '%.ts') AS typescript_files, CAST(0 AS BIGINT) AS javascript_files, count(*) FILTER (path LIKE '%.py') AS python_files, CAST(sum(length(content)) AS BIGINT) AS total_bytes FROM code"
)
def project_stats(spark, sf_dir):
    return discovery.project_stats(_files(spark, sf_dir))


@query(
    """SELECT path, CASE WHEN had IS NULL THEN 'added' WHEN has IS NULL THEN 'removed' ELSE 'modified' END AS change FROM (
  SELECT 'd' || doc_id AS path, sha256(text) AS old, true AS had FROM documents WHERE doc_id % 7 <> 1) o
  FULL JOIN (SELECT 'd' || doc_id AS path, sha256(CASE WHEN doc_id % 5 = 2 THEN text || '.' ELSE text END) AS new, true AS has FROM documents WHERE doc_id % 11 <> 3) n USING (path)
WHERE had IS NULL OR has IS NULL OR old <> new"""
)
def change_detection(spark, sf_dir):
    """Two versions of the documents as files: the second one drops, edits and adds some."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d"), "doc_id").alias("path"), "text")
    old = docs.where("doc_id % 7 <> 1").select("path", discovery.content_hash(F.col("text")).alias("hash"))
    edited = F.when(F.col("doc_id") % 5 == 2, F.concat("text", F.lit("."))).otherwise(F.col("text"))
    new = docs.where("doc_id % 11 <> 3").select("path", discovery.content_hash(edited).alias("hash"))
    return discovery.change_set(old, new)


@query(
    PART_CODE_SQL
    + """, scored AS (SELECT path, CAST(regexp_extract(path, 'p(\\d+)\\.', 1) AS BIGINT) AS ord, path LIKE '%00.ts' AS dirty FROM code)
SELECT path, ord, dirty, CAST(CASE WHEN dirty THEN 0 WHEN path LIKE '%.ts' THEN 18 ELSE 8 END AS INTEGER) AS score FROM scored ORDER BY dirty DESC, score DESC, ord LIMIT 100"""
)
def priority_files(spark, sf_dir):
    files = part_code(spark, sf_dir).select("path", F.regexp_extract("path", r"p(\d+)\.", 1).cast("long").alias("ord"))
    return discovery.prioritised(files, files.where(F.col("path").endswith("00.ts")), 100)


_LINES_SQL = """lines AS (SELECT path, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS line_no, unnest(string_split(content, chr(10))) AS line FROM code),
placed AS (SELECT *, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM lines)"""
_DOC_CODE_SQL = "WITH code AS (SELECT 'd' || doc_id AS path, text AS content FROM documents)"


@query(f"{_DOC_CODE_SQL}, {_LINES_SQL} SELECT path, CAST(line_no AS INTEGER) AS line_no, start, CAST(length(line) AS INTEGER) AS size FROM placed")
def line_offsets(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("path"), F.col("text").alias("content"))
    return symbols.line_table(docs).select("path", "line_no", "start", F.length("line").alias("size"))


@query(PART_CODE_SQL + f", {_LINES_SQL} SELECT path, CAST(2 AS INTEGER) AS line_no, string_agg(line, chr(10) ORDER BY line_no) AS context FROM lines WHERE line_no BETWEEN 1 AND 3 GROUP BY path")
def context_lines(spark, sf_dir):
    files = part_code(spark, sf_dir)
    return symbols.context(files, files.select("path", F.lit(2).alias("line_no")), 1)


def _one_kind(pattern: str, kind: str, role: str, ext: str, group: str = "1") -> str:
    name = f"regexp_extract(line, '{pattern}', 1)" if group == "1" else f"coalesce(nullif(regexp_extract(line, '{pattern}', 1), ''), regexp_extract(line, '{pattern}', 2))"
    return f"SELECT path, CAST(line_no AS INTEGER) AS line_no, {name} AS symbol, '{kind}' AS kind, '{role}' AS type, start, start + length(line) AS \"end\" FROM placed WHERE path LIKE '%{ext}' AND regexp_matches(line, '{pattern}')"


_quoted = lambda p: p.replace("'", "''")
_SYMBOLS_SQL = " UNION ALL ".join(
    [
        _one_kind(symbols.TS_FUNCTION, "function", "def", ".ts"),
        _one_kind(symbols.TS_CLASS, "class", "def", ".ts"),
        _one_kind(symbols.TS_INTERFACE, "interface", "def", ".ts"),
        _one_kind(_quoted(symbols.TS_IMPORT), "import", "ref", ".ts"),
        _one_kind(symbols.PY_FUNCTION, "function", "def", ".py"),
        _one_kind(symbols.PY_CLASS, "class", "def", ".py"),
        _one_kind(symbols.PY_IMPORT, "import", "ref", ".py", "2"),
    ]
)


@query(f"{PART_CODE_SQL}, {_LINES_SQL} {_SYMBOLS_SQL}")
def extract_symbols(spark, sf_dir):
    return symbols.extract_symbols(symbols.line_table(part_code(spark, sf_dir)))


@query(
    f"{PART_CODE_SQL}, {_LINES_SQL}, found AS ({_SYMBOLS_SQL}) SELECT kind, type, count(*) AS n, count(DISTINCT symbol) AS different FROM found GROUP BY 1, 2"
)
def symbol_counts(spark, sf_dir):
    return extract_symbols(spark, sf_dir).groupBy("kind", "type").agg(F.count("*").alias("n"), F.count_distinct("symbol").alias("different"))


@query(
    f"""{PART_CODE_SQL}, {_LINES_SQL}, found AS ({_SYMBOLS_SQL})
SELECT path, symbol, start, "end" FROM found WHERE start >= 20 AND "end" <= 120"""
)
def symbols_in_spans(spark, sf_dir):
    files = part_code(spark, sf_dir)
    spans = files.select("path", F.lit(20).alias("span_start"), F.lit(120).alias("span_end"))
    return symbols.symbols_in_spans(symbols.extract_symbols(symbols.line_table(files)), spans).select("path", "symbol", "start", "end")


_CALLS_SQL = f"""{_LINES_SQL}, marked AS (
  SELECT *, nullif(regexp_extract(line, '{symbols.DEFINITION}', 1), '') AS defined FROM lines
), carried AS (
  SELECT *, count(defined) OVER w AS occurrence, last_value(defined IGNORE NULLS) OVER w AS caller FROM marked WINDOW w AS (PARTITION BY path ORDER BY line_no)
), heads AS (
  SELECT path, caller, max(occurrence) AS occurrence FROM carried WHERE defined IS NOT NULL GROUP BY 1, 2
), calls AS (
  SELECT path, caller, occurrence, line_no, unnest(regexp_extract_all(line, '(\\w+)\\s*\\(', 1)) AS callee FROM carried WHERE defined IS NULL AND caller IS NOT NULL
), kept AS (
  SELECT path, caller, callee, min(line_no) AS first_line FROM calls JOIN heads USING (path, caller, occurrence) WHERE callee <> caller GROUP BY 1, 2, 3
), edges AS (
  SELECT path, caller, callee, CAST(first_line AS INTEGER) AS first_line FROM heads LEFT JOIN kept USING (path, caller)
)"""


@query(f"{PART_CODE_SQL}, {_CALLS_SQL} SELECT path, caller, callee, first_line FROM edges")
def call_graph(spark, sf_dir):
    return symbols.call_edges(symbols.line_table(part_code(spark, sf_dir))).drop("ord")


@query(
    f"""{PART_CODE_SQL}, {_CALLS_SQL}, links AS (SELECT DISTINCT path || '#' || caller AS source, path || '#' || callee AS target FROM edges WHERE callee IS NOT NULL),
d0 AS (SELECT DISTINCT path || '#' || caller AS node, 0 AS depth FROM edges WHERE caller LIKE 'get%' AND callee IS NOT NULL),
d1 AS (SELECT DISTINCT target AS node, 1 AS depth FROM links JOIN d0 ON source = node),
d2 AS (SELECT DISTINCT target AS node, 2 AS depth FROM links JOIN d1 ON source = node)
SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM (FROM d0 UNION ALL FROM d1 UNION ALL FROM d2) GROUP BY node"""
)
def call_graph_reach(spark, sf_dir):
    calls = graph.cut(_calls(spark, sf_dir))
    return graph.reached(calls.select("source", "target").distinct(), calls.where(F.col("caller").startswith("get")).select(F.col("source").alias("node")), 2)


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls between symbols, each told by its file and name."""
    place = lambda c: F.concat_ws("#", "path", c)
    return call_graph(spark, sf_dir).where("callee is not null").select("caller", place("caller").alias("source"), place("callee").alias("target"))


def _pagerank_sql(rounds: int) -> str:
    steps = [
        f"{PART_CODE_SQL}, {_CALLS_SQL}, links AS (SELECT DISTINCT path || '#' || caller AS source, path || '#' || callee AS target FROM edges WHERE callee IS NOT NULL)",
        "nodes AS (SELECT source AS node FROM links UNION SELECT target FROM links)",
        "size AS (SELECT count(*)::DOUBLE AS n FROM nodes)",
        "degree AS (SELECT source, count(*) AS degree FROM links GROUP BY 1)",
        "r0 AS (SELECT node, 1.0::DOUBLE / n AS rank FROM nodes, size)",
    ]
    for k in range(rounds):
        steps.append(f"g{k} AS (SELECT target, sum(rank / degree) AS given FROM links JOIN degree USING (source) JOIN r{k} ON source = node GROUP BY 1)")
        steps.append(f"l{k} AS (SELECT coalesce(sum(rank), 0) AS lost FROM r{k} WHERE node NOT IN (SELECT source FROM degree))")
        steps.append(f"r{k + 1} AS (SELECT node, 0.15::DOUBLE / n + 0.85::DOUBLE * (coalesce(given, 0) + lost / n) AS rank FROM nodes LEFT JOIN g{k} ON node = target, l{k}, size)")
    return ", ".join(steps) + f" SELECT node, round(rank, 9) AS rank FROM r{rounds}"


@query(_pagerank_sql(PAGERANK_ROUNDS))
def call_graph_pagerank(spark, sf_dir):
    ranks = graph.pagerank(_calls(spark, sf_dir), PAGERANK_ROUNDS, tolerance=0.0)
    return ranks.select("node", F.round("rank", 9).alias("rank"))


@query(
    """WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS tokens FROM documents),
c AS (SELECT doc_id, tokens, unnest(range(0, greatest(1, len(tokens) - 64), 336)) AS first FROM t WHERE len(tokens) > 0)
SELECT doc_id, CAST(first / 336 AS INTEGER) AS chunk_no, CAST(len(tokens[first + 1 : first + 400]) AS INTEGER) AS n_tokens, md5(array_to_string(tokens[first + 1 : first + 400], ' ')) AS chunk_md5 FROM c"""
)
def token_chunks(spark, sf_dir):
    cut = chunks.token_chunks(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "chunk_no", "n_tokens", F.md5("chunk").alias("chunk_md5"))


_SAMPLES = "SELECT event_type, user_id, ts, event_id % 1000 AS value FROM events"
_GROWN_SQL = f"""WITH samples AS ({_SAMPLES}), grown AS (
  SELECT *, CASE WHEN lag(value) OVER w IS NULL THEN 0 WHEN value < lag(value) OVER w THEN value ELSE value - lag(value) OVER w END AS increase
  FROM samples WINDOW w AS (PARTITION BY event_type, user_id ORDER BY ts))"""


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_type", "user_id", "ts", (F.col("event_id") % 1000).alias("value"))


@query(f"{_GROWN_SQL} SELECT event_type, user_id, CAST(sum(increase) AS DOUBLE) AS increase FROM grown GROUP BY 1, 2")
def counter_increase(spark, sf_dir):
    grown = telemetry.counter_increase(_samples(spark, sf_dir), ["event_type", "user_id"])
    return grown.groupBy("event_type", "user_id").agg(F.sum("increase").cast("double").alias("increase"))


@query(f"{_GROWN_SQL} SELECT event_type, user_id, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS window_start, round(sum(increase) / 3600.0::DOUBLE, 9) AS rate FROM grown GROUP BY 1, 2, 3")
def counter_rate(spark, sf_dir):
    out = telemetry.rate(_samples(spark, sf_dir), ["event_type", "user_id"], 3600)
    return out.select("event_type", "user_id", F.unix_seconds("window_start").alias("window_start"), F.round("rate", 9).alias("rate"))


_LE = [5.0, 10.0, 25.0, 50.0, 100.0, float("inf")]


@query(
    f"""WITH b AS (SELECT event_type, le, count(*) FILTER (value <= le) AS n FROM events, (SELECT unnest([{", ".join(f"{x}::DOUBLE" for x in _LE[:-1])}, 'inf'::DOUBLE]) AS le) GROUP BY 1, 2),
m AS (SELECT *, coalesce(lag(n) OVER w, 0) AS below, coalesce(lag(le) OVER w, 0) AS lower, 0.9::DOUBLE * max(n) OVER (PARTITION BY event_type) AS wanted FROM b WINDOW w AS (PARTITION BY event_type ORDER BY le)),
f AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY le) AS nth FROM m WHERE n >= wanted)
SELECT event_type, round(CASE WHEN isinf(le) THEN lower ELSE lower + (le - lower) * (wanted - below) / (n - below) END, 6) AS quantile FROM f WHERE nth = 1"""
)
def histogram_quantile(spark, sf_dir):
    """Cumulative buckets are counted in one aggregation; only they are sorted."""
    events = _table(spark, sf_dir, "events")
    wide = events.groupBy("event_type").agg(F.array(*[F.struct(F.lit(x).alias("le"), F.count_if(F.col("value") <= x).alias("count")) for x in _LE]).alias("b"))
    out = telemetry.histogram_quantile(wide.select("event_type", F.inline("b")), ["event_type"], 0.9)
    return out.select("event_type", F.round("quantile", 6).alias("quantile"))


_HOURS_SQL = "WITH points AS (SELECT event_type, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS hour, avg(value) AS mean_value FROM events GROUP BY 1, 2)"


def _hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = (F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600) * 3600).cast("long")
    return _table(spark, sf_dir, "events").groupBy("event_type", at.alias("at")).agg(F.avg("value").alias("mean_value"))


@query(
    f"""{_HOURS_SQL}, f AS (SELECT *, mean_value > 20 AS hot FROM points),
c AS (SELECT *, CASE WHEN hot <> coalesce(lag(hot) OVER (PARTITION BY event_type ORDER BY hour), false) THEN 1 ELSE 0 END AS changed FROM f),
i AS (SELECT *, sum(changed) OVER (PARTITION BY event_type ORDER BY hour) AS island FROM c)
SELECT event_type, min(hour) AS pending_since, max(hour) AS last_true, count(*) AS samples FROM i WHERE hot GROUP BY event_type, island HAVING max(hour) - min(hour) >= 7200"""
)
def alerts_firing(spark, sf_dir):
    points = _hours(spark, sf_dir).withColumn("ts", F.timestamp_seconds("at"))
    out = telemetry.firing(points, ["event_type"], F.col("mean_value") > 20, 7200)
    return out.select("event_type", F.unix_seconds("pending_since").alias("pending_since"), F.unix_seconds("last_true").alias("last_true"), "samples")


_ALERTS_SQL = "SELECT c_custkey AS id, c_nationkey AS service, c_mktsegment AS cluster, CASE WHEN c_acctbal < 0 THEN 'critical' WHEN c_acctbal < 3000 THEN 'warning' ELSE 'info' END AS severity FROM customer"


@query(f"WITH a AS ({_ALERTS_SQL}) SELECT * FROM a WHERE severity <> 'warning' OR NOT EXISTS (SELECT 1 FROM a c WHERE c.severity = 'critical' AND c.service = a.service AND c.cluster = a.cluster)")
def alerts_inhibited(spark, sf_dir):
    balance = F.col("c_acctbal")
    alerts = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("service"), F.col("c_mktsegment").alias("cluster"), F.when(balance < 0, "critical").when(balance < 3000, "warning").otherwise("info").alias("severity"))
    return telemetry.inhibited(alerts, ["service", "cluster"])


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def absent_series(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return telemetry.absent(_table(spark, sf_dir, "customer").select("c_custkey"), orders, ["c_custkey"])


@query(
    """WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 60 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT user_id, epoch_us(min(ts)) AS session_start, epoch_us(max(ts)) AS last_ts, count(*) AS n_events FROM s GROUP BY user_id, k"""
)
def session_timeout(spark, sf_dir):
    out = telemetry.sessions(_table(spark, sf_dir, "events"), "user_id", "60 minutes")
    return out.select("user_id", F.unix_micros("session_start").alias("session_start"), F.unix_micros(F.col("last_ts").cast("timestamp")).alias("last_ts"), "n_events")


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS nth FROM events) WHERE nth = 1")
def latest_status(spark, sf_dir):
    return telemetry.latest(_table(spark, sf_dir, "events"), "user_id", "event_id", "event_type", "value")


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def log_fields(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    return events.groupBy("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id FROM events WHERE CAST('0x' || substr(md5('22:' || user_id), 1, 8) AS BIGINT) % 100 < 10")
def trace_sample(spark, sf_dir):
    return telemetry.sampled(_table(spark, sf_dir, "events"), "user_id", 10).select("event_id", "user_id")


_COUNTS_SQL = """WITH c AS (SELECT p_name || p_partkey AS name, p_type AS category, p_partkey % 6 + 1 AS ea, p_partkey % 5 + 1 AS es, p_partkey % 5 AS v, p_partkey % 7 AS dep, p_size AS opts,
  p_partkey % 6 + 1 AS it, p_partkey % 7 + 1 AS par, p_partkey % 8 AS sections, p_size * 100 AS density, p_partkey % 4 AS checks FROM part),
m AS (SELECT *, (least(ea * 15 + dep * 5, 100) + least(es * 20 + par * 5, 100) + least(v * 20, 100) + least(opts * 2, 100)) / 4.0::DOUBLE AS complexity,
  CASE WHEN it <= 2 AND par >= 4 THEN 'very-fast' WHEN it <= 3 AND par >= 3 THEN 'fast' WHEN it <= 4 AND par >= 2 THEN 'moderate' WHEN it <= 5 THEN 'slow' ELSE 'very-slow' END AS speed,
  least(it * 15 + v * 10 + es * 5, 100)::DOUBLE AS thoroughness, least(v * 20 + 20, 100)::DOUBLE AS accuracy, least(ea * 15 + sections * 10, 100)::DOUBLE AS comprehensiveness,
  least(checks * 25 + CASE WHEN v >= 3 THEN 25 ELSE v * 8 END, 100)::DOUBLE AS reliability, CAST(ea * it * 2500 + es * 1000 + density AS BIGINT) AS tokens,
  CASE WHEN ea + es + par <= 5 THEN 'light' WHEN ea + es + par <= 10 THEN 'moderate' WHEN ea + es + par <= 15 THEN 'intensive' ELSE 'extreme' END AS level,
  greatest(1.0::DOUBLE, it * ea * 1.5::DOUBLE / par) AS minutes FROM c),
s AS (SELECT *, least(100.0::DOUBLE, thoroughness / (tokens / 1000.0::DOUBLE) * 0.3::DOUBLE + thoroughness / minutes * 0.3::DOUBLE + (thoroughness + reliability) / (tokens / 1000.0::DOUBLE + minutes) * 0.4::DOUBLE) AS cost_benefit,
  least(100.0::DOUBLE, (thoroughness + reliability + accuracy) / 3 * 0.4::DOUBLE + greatest(1, 10 - it) * 10 * 0.3::DOUBLE + least(10, par) * 10 * 0.2::DOUBLE + (100 - complexity * 0.5::DOUBLE) * 0.1::DOUBLE) AS benchmark FROM m)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of configurations made up from the parts, one for each."""
    key, size = F.col("p_partkey"), F.col("p_size")
    counts = _table(spark, sf_dir, "part").select(
        F.concat("p_name", "p_partkey").alias("name"), F.col("p_type").alias("category"), (key % 6 + 1).alias("ea"), (key % 5 + 1).alias("es"), (key % 5).alias("v"), (key % 7).alias("dep"), size.alias("opts"),
        (key % 6 + 1).alias("it"), (key % 7 + 1).alias("par"), (key % 8).alias("sections"), (size * 100).alias("density"), (key % 4).alias("checks"),
        key.alias("ord"), (key % 10 / 10).alias("threshold"), F.when(key % 3 == 0, (size * 64).cast("double")).alias("max_memory"),
    )
    return loadouts.metrics(counts)


_METRICS = ["complexity", "thoroughness", "accuracy", "comprehensiveness", "reliability", "minutes", "cost_benefit", "benchmark"]


@query(f"{_COUNTS_SQL} SELECT name, speed, level, tokens, {', '.join(f'round({c}, 6) AS {c}' for c in _METRICS)} FROM s")
def loadout_metrics(spark, sf_dir):
    return _scored(spark, sf_dir).select("name", "speed", "level", "tokens", *[F.round(c, 6).alias(c) for c in _METRICS])


@query(
    f"""{_COUNTS_SQL}, r AS (SELECT name, category, thoroughness, rank() OVER (PARTITION BY category ORDER BY thoroughness DESC) AS rank, count(*) OVER (PARTITION BY category) AS n FROM s)
SELECT name, category, CAST(rank AS INTEGER) AS rank, CAST(floor((n - rank + 1)::DOUBLE / n * 100 + 0.5) AS BIGINT) AS percentile FROM r"""
)
def loadout_ranks(spark, sf_dir):
    return loadouts.ranked(_scored(spark, sf_dir), "thoroughness").select("name", "category", "rank", "percentile")


@query(
    f"""{_COUNTS_SQL}, p AS (SELECT name, CASE WHEN speed IN ('fast', 'very-fast') THEN 20 ELSE -10 END + CASE WHEN thoroughness >= 70 THEN 25 ELSE -15 END + 15 + benchmark * 0.3::DOUBLE AS score FROM s)
SELECT name, round(score, 6) AS score, CAST(least(95, greatest(60, floor(score + 0.5))) AS BIGINT) AS confidence FROM p ORDER BY p.score DESC, name LIMIT 3"""
)
def loadout_recommendation(spark, sf_dir):
    out = loadouts.recommended(_scored(spark, sf_dir), speed="fast", quality="good", budget="moderate")
    return out.select("name", F.round("score", 6).alias("score"), "confidence")


@query(
    """WITH r AS (SELECT l_returnflag || l_linestatus AS category, 'r' || l_orderkey || '-' || l_linenumber AS risk, round(l_quantity * l_discount * 2, 6) AS score FROM lineitem)
SELECT category, count(*) AS n, round(avg(score), 6) AS mean_score, count(*) FILTER (score >= 6) AS critical, count(*) FILTER (score >= 3 AND score < 6) AS moderate,
  (SELECT min(x.risk) FROM r x WHERE x.category = r.category AND x.score = max(r.score)) AS top_risk FROM r GROUP BY category"""
)
def risk_by_category(spark, sf_dir):
    items = _table(spark, sf_dir, "lineitem")
    risks = items.select(F.concat("l_returnflag", "l_linestatus").alias("category"), F.concat(F.lit("r"), "l_orderkey", F.lit("-"), "l_linenumber").alias("risk"), F.round(F.col("l_quantity") * F.col("l_discount") * 2, 6).alias("score"))
    return research.risk_by_category(risks).withColumn("mean_score", F.round("mean_score", 6))


@query(
    """SELECT o_custkey, o_orderpriority, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, first_seen) AS k FROM (
  SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS first_seen FROM orders GROUP BY 1, 2)) WHERE k = 1"""
)
def most_frequent_priority(spark, sf_dir):
    return research.most_frequent(_table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", "o_orderkey")


@query(
    """WITH e AS (SELECT user_id AS run, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS iteration, list(DISTINCT event_type) AS cats, avg(value / 100) AS mean FROM events GROUP BY 1, 2),
b AS (SELECT *, lag(cats) OVER w AS was, lag(mean) OVER w AS had FROM e WINDOW w AS (PARTITION BY run ORDER BY iteration))
SELECT run, iteration, round(CASE WHEN was IS NULL THEN 0 ELSE greatest(0, len(list_intersect(cats, was))::DOUBLE / len(list_distinct(list_concat(cats, was))) * (1 - least(abs(mean - had), 1))) END, 9) AS convergence FROM b"""
)
def convergence(spark, sf_dir):
    day = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400).cast("long")
    findings = _table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), day.alias("iteration"), F.col("event_type").alias("category"), (F.col("value") / 100).alias("confidence"))
    return research.convergence(findings).withColumn("convergence", F.round("convergence", 9))


@query("SELECT lang, count(*) AS n, count(*) FILTER (regexp_matches(lower(text), '\\bthe\\b')) AS with_word, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang")
def language_histogram(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return docs.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(whole_word(F.lower("text"), "the")).alias("with_word"), F.sum("n_chars").alias("chars"))
