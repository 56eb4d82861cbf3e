"""Registered queries over telemetry, search results, graphs and files, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text
from skein.functions.vectors import norm, normalized
from skein.operators import chunks, discovery, graph, search, symbols, telemetry
from skein.plans.queries import _CALLS_SQL, _DOC_CODE_SQL, _GROWN_SQL, _HOURS_SQL, _LINES_SQL, _SYMBOLS_SQL, _first_vector, _hours, _samples, _table, query
from skein.sources.code_view import PART_CODE_SQL, part_code
from skein.sources.shared import shared_folder
from skein.streaming import metrics

KEYS = ["event_type", "user_id"]


@query(
    f"""{_GROWN_SQL}, w AS (SELECT event_type, user_id, increase, unnest(list_transform(range(4), lambda k: CAST(floor(epoch(ts) / 900) * 900 AS BIGINT) - 900 * k + 3600)) AS "at" FROM grown)
SELECT event_type, user_id, "at", round(sum(increase) / 3600.0::DOUBLE, 9) AS rate FROM w GROUP BY 1, 2, 3"""
)
def sliding_rate(spark, sf_dir):
    """Growth per second over an hour, every quarter of an hour."""
    return telemetry.sliding_rate(_samples(spark, sf_dir), KEYS, 3600, 900).withColumn("rate", F.round("rate", 9))


_TUMBLED_SQL = f"{_GROWN_SQL}, r AS (SELECT event_type, user_id, CAST(floor(epoch(ts) / 3600) * 3600 + 3600 AS BIGINT) AS \"at\", sum(increase) / 3600.0::DOUBLE AS rate FROM grown GROUP BY 1, 2, 3)"


@query(
    f"""{_TUMBLED_SQL}, e AS (SELECT event_type, user_id, rate, unnest(list_transform(range(6), lambda k: r."at" + 3600 * k)) AS "at" FROM r)
SELECT event_type, user_id, "at", round(avg(rate), 9) AS rate FROM e GROUP BY 1, 2, 3"""
)
def mean_of_rates(spark, sf_dir):
    """A subquery: the mean over six hours of rates over one hour."""
    rates = telemetry.sliding_rate(_samples(spark, sf_dir), KEYS, 3600, 3600)
    return telemetry.mean_over(rates, KEYS, "rate", 6 * 3600, 3600).withColumn("rate", F.round("rate", 9))


@query(
    """WITH s AS (SELECT event_type, value, event_id, epoch_us(ts) / 1000000.0::DOUBLE AS t FROM events), e AS (SELECT *, unnest(list_transform(range(2), lambda k: CAST(ceil(t / 300) * 300 AS BIGINT) + 300 * k)) AS "at" FROM s)
SELECT event_type, "at", value FROM (SELECT *, row_number() OVER (PARTITION BY event_type, "at" ORDER BY t DESC, event_id DESC) AS k FROM e WHERE "at" - t <= 300) WHERE k = 1"""
)
def instant_values(spark, sf_dir):
    """The last value of each series at every five minutes, no older than five minutes."""
    events = _table(spark, sf_dir, "events").select("event_type", "value", "event_id", "ts")
    return telemetry.instant(events, ["event_type"], "event_id", 300)


@query("SELECT o_orderkey FROM orders WHERE regexp_full_match(o_orderpriority, '[12]-.*') AND o_orderstatus <> 'F' AND NOT regexp_full_match(CAST(o_custkey AS VARCHAR), '.*[05]')")
def matched_series(spark, sf_dir):
    found = telemetry.matching(_table(spark, sf_dir, "orders"), o_orderpriority=("=~", "[12]-.*"), o_orderstatus=("!=", "F"), o_custkey=("!~", ".*[05]"))
    return found.select("o_orderkey")


@query(
    """WITH c AS (SELECT user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, count(*) AS n, count(*) FILTER (event_type = 'error') AS bad FROM events GROUP BY 1, 2)
SELECT user_id, day, round(bad / n, 9) AS ratio FROM c WHERE bad > 0"""
)
def error_ratio(spark, sf_dir):
    """Errors by all events of the same user and day, where there are errors."""
    events = _table(spark, sf_dir, "events").withColumn("day", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400).cast("long"))
    counted = lambda rows: rows.groupBy("user_id", "day").agg(F.count("*").alias("n"))
    out = telemetry.ratio(counted(events.where("event_type = 'error'")), counted(events), ["user_id", "day"], "n")
    return out.withColumn("ratio", F.round("ratio", 9))


@query("SELECT event_id, props FROM events WHERE contains(props, '1') AND NOT regexp_matches(props, '2|3') ORDER BY ts DESC, event_id DESC LIMIT 200")
def newest_log_lines(spark, sf_dir):
    lines = telemetry.log_lines(_table(spark, sf_dir, "events"), "props", "1", without="2|3")
    return telemetry.newest(lines, ["ts", "event_id"], 200).select("event_id", "props")


@query(
    """WITH b AS (SELECT event_type, user_id % 7 AS service, epoch_us(ts) / 1000000.0::DOUBLE AS t FROM events), g AS (SELECT *, min(t) OVER (PARTITION BY event_type, service) AS begun FROM b)
SELECT event_type, service, CAST(greatest(0, ceil((t - begun - 600) / 3600)) AS BIGINT) AS nth, round(begun + 600 + greatest(0, ceil((t - begun - 600) / 3600)) * 3600, 3) AS at, count(*) AS alerts FROM g GROUP BY 1, 2, 3, 4"""
)
def alert_notifications(spark, sf_dir):
    alerts = _table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 7).alias("service"), "ts")
    return telemetry.notifications(alerts, ["event_type", "service"], wait=600, interval=3600).withColumn("at", F.round("at", 3))


@query("")
def rate_limited(spark, sf_dir):
    """Requests of each user that a bucket of three, drained at two an hour, lets pass."""
    events = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return telemetry.limited(events, "user_id", "event_id", rate=2 / 3600, burst=2.0).select("event_id", "user_id", "allowed")


@query(
    """WITH r AS (SELECT o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT o_orderpriority, CAST(max(n) AS BIGINT) AS n, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS least, max(o_totalprice) AS largest, max(o_totalprice) FILTER (k = CAST(floor(n * 0.95::DOUBLE) AS BIGINT) + 1) AS quantile FROM r GROUP BY 1"""
)
def load_statistics(spark, sf_dir):
    out = telemetry.load_statistics(_table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice")
    return out.withColumn("mean", F.round("mean", 4))


@query(
    """SELECT event_type, count(*) AS calls, round(avg(value), 6) AS mean_seconds, round(count(*) FILTER (event_id % 9 = 0) / count(*), 9) AS error_rate, count(DISTINCT user_id) AS sessions FROM events GROUP BY 1"""
)
def trace_figures(spark, sf_dir):
    traces = _table(spark, sf_dir, "events").select("event_type", F.col("user_id").alias("session"), F.col("value").alias("seconds"), (F.col("event_id") % 9 != 0).alias("success"))
    return telemetry.trace_figures(traces, "event_type").withColumns({"mean_seconds": F.round("mean_seconds", 6), "error_rate": F.round("error_rate", 9)})


@query(f"{_HOURS_SQL}, e AS (SELECT event_type, mean_value, unnest(list_transform(range(24), lambda k: hour + 3600 * k)) AS \"at\" FROM points) SELECT event_type, \"at\", round(avg(mean_value), 9) AS mean_value FROM e GROUP BY 1, 2")
def mean_over_day(spark, sf_dir):
    return telemetry.mean_over(_hours(spark, sf_dir), ["event_type"], "mean_value", 86400, 3600).withColumn("mean_value", F.round("mean_value", 9))


@query(
    """WITH c AS (SELECT p_name AS path, CASE WHEN p_size % 3 = 0 THEN p_size END AS start, CASE WHEN p_size % 3 = 0 THEN p_size + 9 END AS "end", CASE WHEN p_size % 4 > 0 THEN p_size / 50.0::DOUBLE END AS score,
  CASE WHEN p_size % 5 > 0 THEN p_type END AS content, CASE WHEN p_size % 2 > 0 THEN p_brand END AS rev FROM part)
SELECT path, coalesce(start, 0) AS start, coalesce("end", 0) AS "end", round(coalesce(score, 0), 6) AS score, coalesce(content, '') AS content, coalesce(rev, 'main') AS rev, '' AS sha, '/repo' AS root FROM c"""
)
def search_results(spark, sf_dir):
    size = F.col("p_size")
    rows = _table(spark, sf_dir, "part").select(
        F.col("p_name").alias("path"), F.when(size % 3 == 0, size).alias("start"), F.when(size % 3 == 0, size + 9).alias("end"), F.when(size % 4 > 0, size / 50).alias("score"),
        F.when(size % 5 > 0, F.col("p_type")).alias("content"), F.when(size % 2 > 0, F.col("p_brand")).alias("rev"), F.lit(None).cast("string").alias("hash"),
    )
    out = search.as_results(rows, "/repo")
    return out.select("path", "span.start", "span.end", F.round("score", 6).alias("score"), "content", "citation.rev", F.col("citation.content_sha").alias("sha"), F.col("citation.repo_root").alias("root"))


_COS_SQL = "round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)"


@query(f"SELECT e.vec_id, label, {_COS_SQL} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE label = 3 AND {_COS_SQL} >= 0.1")
def filtered_search(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings")
    return search.filtered(search.vector_scores(vectors, _first_vector(vectors)), least=0.1, label=3).select("vec_id", "label", "score")


_NEAR_SQL = f"near AS (SELECT e.vec_id AS id, label AS index, {_COS_SQL} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return search.vector_scores(vectors, _first_vector(vectors)).select(F.col("vec_id").alias("id"), F.col("label").alias("index"), "score")


@query(f"WITH {_NEAR_SQL} SELECT id, index, score FROM (SELECT *, row_number() OVER (PARTITION BY index ORDER BY score DESC, id) AS k FROM near) WHERE k <= 5 ORDER BY score DESC, id, index LIMIT 10")
def merged_search(spark, sf_dir):
    """The labels taken as indexes of their own: five of each, ten in all."""
    return search.merged_indexes(_near(spark, sf_dir), "index")


@query(f"WITH {_NEAR_SQL} SELECT id, index, round(id % 17 / 17.0::DOUBLE, 9) AS score FROM (SELECT * FROM near ORDER BY score DESC, id LIMIT 60) ORDER BY id % 17 DESC, id LIMIT 20")
def reranked_search(spark, sf_dir):
    return search.reranked(_near(spark, sf_dir), F.col("id") % 17 / 17, first=60).withColumn("score", F.round("score", 9))


@query(
    """WITH h AS (SELECT l_partkey AS path, l_suppkey % 5 AS start, l_suppkey % 5 + 4 AS "end", l_orderkey * 10 + l_linenumber AS id, l_discount AS score FROM lineitem),
b AS (SELECT *, row_number() OVER (PARTITION BY path, start, "end" ORDER BY score DESC, id) AS k FROM h)
SELECT path, start, "end", id, score, CAST(row_number() OVER (PARTITION BY path ORDER BY score DESC, start, "end") AS INTEGER) AS rank FROM b WHERE k = 1"""
)
def ranked_snippets(spark, sf_dir):
    start = F.col("l_suppkey") % 5
    hits = _table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("path"), start.alias("start"), (start + 4).alias("end"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_discount").alias("score"))
    return search.snippets(hits)


@query(f"{PART_CODE_SQL} SELECT path, 30 AS start, 60 AS \"end\", substr(content, 31, 30) AS text, substr(content, 21, 10) AS before, substr(content, 61, 10) AS after FROM code")
def span_context(spark, sf_dir):
    files = part_code(spark, sf_dir)
    return search.span_context(files, files.select("path", F.lit(30).alias("start"), F.lit(60).alias("end")), 10)


_IMPORTS_SQL = f"""{PART_CODE_SQL}, {_LINES_SQL}, found AS ({_SYMBOLS_SQL}), i AS (SELECT path AS source, symbol AS module FROM found WHERE kind = 'import'),
pages AS (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) || '/' || split_part(path, '/', 2) || '.ts' AS target FROM code),
edges AS (SELECT DISTINCT source, target FROM i JOIN pages ON target = regexp_extract(source, '^(.*/)[^/]*$', 1) || substr(module, 3) || '.ts' WHERE module LIKE './%')"""


def _import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports of the code view resolved to one index file in each folder."""
    files = part_code(spark, sf_dir)
    found = symbols.extract_symbols(symbols.line_table(files)).where("kind = 'import'").select("path", F.col("symbol").alias("module"))
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    return graph.resolved_imports(found, files.select(F.concat(folder, F.lit("/"), F.element_at(F.split("path", "/"), 2), F.lit(".ts")).alias("path")).distinct())


@query(f"{_IMPORTS_SQL} SELECT source, target FROM edges")
def import_edges(spark, sf_dir):
    return _import_edges(spark, sf_dir)


@query(
    f"""{_IMPORTS_SQL}, c AS (SELECT path, CAST(regexp_extract(path, 'p(\\d+)\\.', 1) AS BIGINT) % 100 / 100.0::DOUBLE AS score FROM code)
SELECT path, round(max(score), 6) AS score FROM (SELECT path, score FROM c UNION ALL SELECT target, score * 0.3::DOUBLE FROM c JOIN edges ON source = path) GROUP BY path"""
)
def expanded_candidates(spark, sf_dir):
    candidates = part_code(spark, sf_dir).select("path", (F.regexp_extract("path", r"p(\d+)\.", 1).cast("long") % 100 / 100).alias("score"))
    return search.expanded(candidates, _import_edges(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(
    PART_CODE_SQL
    + """, f AS (SELECT path, length(content) AS size, CASE WHEN path LIKE '%.py' OR path LIKE '%.ts' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS w FROM code)
SELECT path, round((least(size / 1000.0::DOUBLE, 100) / 100 + w) / 2.5::DOUBLE, 9) AS rank, round((least(size / 1000.0::DOUBLE, 100) / 100 + w) / 2.5::DOUBLE * 0.8::DOUBLE, 9) AS centrality FROM f"""
)
def repomap(spark, sf_dir):
    out = graph.repomap(part_code(spark, sf_dir).select("path", F.length("content").alias("size")))
    return out.select("path", F.round("rank", 9).alias("rank"), F.round("centrality", 9).alias("centrality"))


@query(
    f"""{PART_CODE_SQL}, {_CALLS_SQL}, found AS (SELECT path, symbol FROM ({_SYMBOLS_SQL}) WHERE kind = 'function'), every AS (SELECT symbol, count(DISTINCT path) AS definitions, min(path) AS first_path FROM found GROUP BY 1)
SELECT e.path AS ref_path, e.first_line AS line_no, e.callee AS symbol, CASE WHEN (e.path, e.callee) IN (SELECT path, symbol FROM found) THEN e.path ELSE first_path END AS def_path, coalesce(definitions, 0) AS definitions
FROM edges e LEFT JOIN every ON callee = symbol WHERE callee IS NOT NULL"""
)
def resolved_references(spark, sf_dir):
    """All calls with the definition that they mean."""
    lines = symbols.line_table(part_code(spark, sf_dir))
    calls = symbols.call_edges(lines).where("callee IS NOT NULL")
    refs = calls.select("path", F.col("first_line").alias("line_no"), F.col("callee").alias("symbol"), F.lit("function").alias("kind"), F.lit("ref").alias("type"))
    defs = symbols.extract_symbols(lines).where("kind = 'function'").select("path", "line_no", "symbol", "kind", "type")
    return symbols.resolved_once(refs.unionByName(defs))


@query(
    f"""{_DOC_CODE_SQL}, l AS (SELECT path, string_split(content, chr(10)) AS lines FROM code), c AS (SELECT path, unnest(range(0, len(lines), 4)) AS first_line, lines FROM l),
t AS (SELECT path, CAST(first_line AS INTEGER) AS first_line, array_to_string(lines[first_line + 1 : first_line + 4], chr(10)) AS chunk FROM c)
SELECT path, first_line, md5(chunk) AS chunk_md5 FROM t WHERE length(trim(chunk, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) >= 50"""
)
def line_chunks(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("path"), F.col("text").alias("content"))
    return chunks.line_chunks(docs, 40).select("path", "first_line", F.md5("chunk").alias("chunk_md5"))


@query("SELECT p_name || p_partkey AS path, CAST(floor((sum(p_size) OVER (ORDER BY p_name || p_partkey ROWS UNBOUNDED PRECEDING) - p_size) / 200) AS BIGINT) AS shard FROM part")
def bundle_shards(spark, sf_dir):
    files = _table(spark, sf_dir, "part").select(F.concat("p_name", "p_partkey").alias("path"), F.col("p_size").alias("size"))
    return discovery.sharded(files, 200).select("path", F.col("shard").cast("long").alias("shard"))


@query("SELECT CAST(sum(p_size) AS BIGINT) AS bytes, sum(p_size) >= 1500 AS warned, CAST(greatest(1, ceil(sum(p_size) / 2000.0::DOUBLE)) AS BIGINT) AS shards FROM part")
def bundle_size(spark, sf_dir):
    files = _table(spark, sf_dir, "part").select(F.col("p_name").alias("path"), F.col("p_size").alias("size"))
    return discovery.bundle_size(files, warning=1500, limit=2000).select("bytes", "warned", F.col("shards").cast("long").alias("shards"))


@query(
    f"""{PART_CODE_SQL}, f AS (SELECT path, length(content) AS size, round((least(length(content) / 1000.0::DOUBLE, 100) / 100 + 1.5::DOUBLE) / 2.5::DOUBLE, 9) AS rank FROM code),
r AS (SELECT *, sum(size) OVER (ORDER BY rank DESC, path ROWS UNBOUNDED PRECEDING) AS running FROM f)
SELECT path, rank, CAST(running AS BIGINT) AS running FROM r WHERE running <= 40000"""
)
def ranked_prefix(spark, sf_dir):
    """The highest ranked files that together fit into forty thousand characters."""
    files = part_code(spark, sf_dir).select("path", F.length("content").alias("size"))
    ranked = files.join(graph.repomap(files).hint("merge"), "path").withColumn("rank", F.round("rank", 9))
    return discovery.within_budget(ranked, 40_000, [F.desc("rank"), F.col("path")]).select("path", "rank", "running")


_WANTED = ["README.md", "package.json", "LICENSE"]


@query(
    f"""WITH f AS (SELECT p_brand || '-' || p_size AS repository, [{", ".join(f"'{n}'" for n in _WANTED)}][p_partkey % 7 + 1] AS name FROM part),
w AS (SELECT DISTINCT repository, n.name FROM f, (SELECT unnest([{", ".join(f"'{n}'" for n in _WANTED)}]) AS name) n)
SELECT repository, name FROM w EXCEPT SELECT repository, name FROM f WHERE name IS NOT NULL"""
)
def missing_files(spark, sf_dir):
    """Important files that a repository, one for each brand and size, lacks."""
    name = F.try_element_at(F.array(*map(F.lit, _WANTED)), (F.col("p_partkey") % 7 + 1).cast("int"))
    files = _table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("-"), "p_size").alias("repository"), F.concat(F.lit("a/"), F.coalesce(name, F.concat(F.lit("f"), "p_partkey"))).alias("path"))
    return discovery.missing_important(files, _WANTED, ["repository"])


@query(
    """WITH q AS (SELECT doc_id, lower(text) AS t, text FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(t, '\\b(why|analyze|compare|evaluate|trade-?offs?)\\b') THEN 'complex' WHEN regexp_matches(t, '\\b(how|explain|design|describe)\\b') THEN 'medium' ELSE 'simple' END AS class,
  CASE WHEN regexp_matches(t, '\\b(calls?|callers?|called|invokes?)\\b') THEN 'callgraph' WHEN regexp_matches(t, '\\b(imports?|depends?|dependency|dependencies)\\b') THEN 'import'
    WHEN regexp_matches(t, '\\b(files?|where|path)\\b') THEN 'file' ELSE 'symbol' END AS intent, left(text, 100) || '...' AS preview, CAST(ceil(length(text) / 4.0::DOUBLE) AS BIGINT) AS tokens FROM q"""
)
def question_kinds(spark, sf_dir):
    """Documents taken as questions: class, intent, preview and estimated tokens."""
    ask = F.col("text")
    return _table(spark, sf_dir, "documents").select("doc_id", text.question_class(ask).alias("class"), text.question_intent(ask).alias("intent"), text.preview(F.col("text")).alias("preview"), text.token_estimate(F.col("text")).alias("tokens"))


@query(
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS size FROM embeddings)
SELECT vec_id, round(v[1] / size, 6) AS first, round(list_sum(list_transform(v, lambda x: abs(x / size))), 6) AS total, round(list_sum(list_transform(v, lambda x: (x / size) * (x / size))), 6) AS norm FROM v"""
)
def normalized_vectors(spark, sf_dir):
    """The first component, the sum of sizes and the length of each vector scaled to length one."""
    unit = _table(spark, sf_dir, "embeddings").select("vec_id", normalized(F.col("embedding")).alias("unit"))
    total = F.aggregate(F.transform("unit", lambda x: F.abs(x)), F.lit(0.0), lambda a, x: a + x)
    return unit.select("vec_id", F.round(F.element_at("unit", 1), 6).alias("first"), F.round(total, 6).alias("total"), F.round(norm(F.col("unit")), 6).alias("norm"))


@query(
    """SELECT event_type, CAST(floor(epoch(ts) / 86400) * 86400 AS BIGINT) AS day, round(avg(value), 6) AS mean_value, count(*) AS n FROM events GROUP BY 1, 2"""
)
def streamed_means(spark, sf_dir):
    """Daily means by a stream over the events, kept up to date in a table by key."""
    folder = f"{shared_folder(spark)}/skein-means-{uuid.uuid4().hex}"
    events = _table(spark, sf_dir, "events")
    events.write.parquet(f"{folder}/arrived")
    means = metrics.windowed_means(metrics.read_events(spark, f"{folder}/arrived", events.schema), width="1 day", late="400 days")
    keyed = means.withColumn("key", F.concat_ws("|", "event_type", F.unix_seconds("window_start")))
    metrics.upsert_latest(keyed, f"{folder}/table", f"{folder}/checkpoint", "key", "n").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    out = metrics.read_latest(spark, f"{folder}/table", keyed.schema.simpleString()[7:-1].replace(":", " "))
    return out.select("event_type", F.unix_seconds("window_start").alias("day"), F.round("mean_value", 6).alias("mean_value"), "n")
