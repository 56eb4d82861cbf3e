"""Registered queries over configurations as documents: parsing, validation and scores, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import loadouts
from skein.operators.graph import cut
from skein.plans.queries import _COUNTS_SQL, _scored, _table, query
from skein.sources import loadouts as files
from skein.sources.code_view import dealt_parts

_CHECKS = ["logical_consistency", "cross_reference", "semantic", "syntactic"]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content, error) of one JSON configuration for each part; some have faults, every second names its checks."""
    k = F.col("p_partkey")
    many = lambda n, make: F.transform(F.sequence(F.lit(1), n), make)
    ea, es, layers = k % 4 + 1, k % 3 + 1, k % 5
    name = lambda i: F.concat(F.lit("a"), i.cast("string"))

    def agent(i: Column) -> Column:
        config = F.struct(F.lit(0.5).alias("temperature"), F.array(F.concat(F.lit("area"), (k % 6 + i).cast("string"))).alias("specialization"))
        needs = F.slice(F.transform(F.sequence(F.lit(1), i), name), F.lit(1), i - 1)
        weight = F.when((k % 10 == 3) & (i == 1), 1.5).otherwise(0.5)
        return F.struct(F.lit("specialist").alias("type"), name(i).alias("name"), (i <= ea).alias("enabled"), weight.alias("weight"), config.alias("config"), needs.alias("dependencies"))

    def stage(i: Column) -> Column:
        return F.struct(F.concat(F.lit("s"), i.cast("string")).alias("name"), F.lit("call_graph").alias("type"), F.lit(True).alias("enabled"), F.lit(False).alias("parallel"), F.lit(0.25).alias("weight"), F.struct(F.lit(1).alias("deep")).alias("config"))

    def layer(i: int) -> Column:
        return F.struct(F.lit(_CHECKS[i]).alias("type"), (F.lit(i) < layers).alias("enabled"), F.lit(0.5).alias("weight"), F.struct(F.lit(True).alias("strict")).alias("config"))

    pipeline = F.struct(
        (k % 5 + 1).alias("maxIterations"),
        F.lit(0.8).alias("convergenceThreshold"),
        (k % 6 + 1).alias("parallelismLevel"),
        F.lit(60000).alias("timeoutMs"),
        F.when(k % 10 == 5, "other").otherwise("intelligence_gathering").alias("focus"),
        F.lit("swarm_handoff").alias("outputOptimization"),
    )
    output = F.struct(
        F.lit("overview").alias("format"),
        many(k % 7 + 1, lambda i: F.concat(F.lit("part"), i.cast("string"))).alias("sections"),
        (F.lit(500) + k % 9 * 500).alias("densityTarget"),
        F.lit("swarm_consumption").alias("optimizeFor"),
        *[F.lit(True).alias(n) for n in ("includeDebateTopics", "includeMetrics", "includeCitations")],
    )
    performance = F.struct(F.lit(True).alias("cacheResults"), F.lit(30).alias("cacheTtlMinutes"), F.lit(512).alias("maxMemoryMb"), F.lit(False).alias("cpuIntensive"))

    def document(verification: Column) -> Column:
        version = F.when(k % 10 != 7, "1.0.0").alias("version")
        return F.to_json(F.struct(F.concat(F.lit("c"), k.cast("string")).alias("name"), F.lit("d").alias("description"), version, pipeline.alias("pipeline"), many(ea + 1, agent).alias("agents"), many(es, stage).alias("stages"), verification.alias("verification"), output.alias("output"), performance.alias("performance")))

    listed, keyed = F.array(*[layer(i) for i in range(4)]), F.struct(*[layer(i).alias(n) for i, n in enumerate(_CHECKS)])
    content = F.when(k % 25 == 0, '{"name": ').when(k % 2 == 0, document(listed)).otherwise(document(keyed))
    path = F.concat(F.lit("/loadouts/"), F.lower("p_brand"), F.lit("/c"), k.cast("string"), F.lit(".json"))
    # cut, as a filter on what is parsed would else be worked out before parts are dealt
    return cut(dealt_parts(spark, sf_dir).select("p_partkey", "p_brand")).select(k, path.alias("path"), content.alias("content"), F.lit(None).cast("string").alias("error"))


_WHOLE_SQL = """WITH c AS (SELECT p_partkey AS k, p_partkey % 4 + 1 AS ea, p_partkey % 3 + 1 AS es, least(p_partkey % 5, 4) AS v, p_partkey % 5 + 1 AS it, p_partkey % 6 + 1 AS par,
  p_partkey % 7 + 1 AS sections, 500 + p_partkey % 9 * 500 AS density, CASE WHEN p_partkey % 2 = 1 THEN least(p_partkey % 5, 3) ELSE 0 END AS checks, lower(p_brand) AS category FROM part WHERE p_partkey % 25 <> 0),
d AS (SELECT *, ea * (ea - 1) // 2 AS dep, 2 * ea + es AS opts FROM c),
s AS (SELECT *, (least(ea * 15 + dep * 5, 100) + least(es * 20 + par * 5, 100) + least(v * 20, 100) + least(opts * 2, 100)) / 4.0::DOUBLE AS complexity,
  least(it * 15 + v * 10 + es * 5, 100)::DOUBLE AS thoroughness, least(v * 20 + 20, 100)::DOUBLE AS accuracy, least(checks * 25 + CASE WHEN v >= 3 THEN 25 ELSE v * 8 END, 100)::DOUBLE AS reliability FROM d)"""


@query(
    f"""{_WHOLE_SQL} SELECT 'c' || k AS name, category, CAST(ea AS INTEGER) AS ea, CAST(es AS INTEGER) AS es, CAST(v AS INTEGER) AS v, CAST(dep AS INTEGER) AS dep, CAST(opts AS INTEGER) AS opts, CAST(checks AS INTEGER) AS checks,
  complexity, thoroughness, accuracy, reliability, CAST(ea * it * 2500 + es * 1000 + density AS BIGINT) AS tokens,
  round(least(100.0::DOUBLE, (thoroughness + reliability + accuracy) / 3 * 0.4::DOUBLE + greatest(1, 10 - it) * 10 * 0.3::DOUBLE + least(10, par) * 10 * 0.2::DOUBLE + (100 - complexity * 0.5::DOUBLE) * 0.1::DOUBLE), 6) AS benchmark FROM s"""
)
def parsed_loadouts(spark, sf_dir):
    """Scores of configurations read from JSON, whether they list or name their checks; broken ones have none."""
    parsed = files.parsed(_documents(spark, sf_dir)).where("error IS NULL")
    scored = loadouts.metrics(loadouts.counts_of(parsed))
    return scored.select("name", "category", "ea", "es", "v", "dep", "opts", "checks", "complexity", "thoroughness", "accuracy", "reliability", "tokens", F.round("benchmark", 6).alias("benchmark"))


@query(
    """WITH e AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 25 = 0 THEN ['not valid JSON'] ELSE list_filter([
  CASE WHEN p_partkey % 10 = 7 THEN 'version must be a string' END,
  CASE WHEN p_partkey % 10 = 5 THEN 'pipeline.focus must be one of intelligence_gathering, solution_generation' END,
  CASE WHEN p_partkey % 10 = 3 THEN 'agents[0].weight must be a number from 0 to 1' END,
  CASE WHEN p_partkey % 2 = 1 THEN 'verification must be a list' END], lambda x: x IS NOT NULL) END AS errors FROM part)
SELECT '/c' || k || '.json' AS file, array_to_string(errors, '; ') AS errors, len(errors) = 0 AS is_valid FROM e"""
)
def validated_loadouts(spark, sf_dir):
    """What is wrong with each configuration."""
    out = files.validated(files.parsed(_documents(spark, sf_dir)))
    return out.select(F.regexp_extract("path", "/c[0-9]+[.]json$", 0).alias("file"), F.array_join("errors", "; ").alias("errors"), "is_valid")


_LEVELS = ["generalist", "specialized", "expert", "niche"]
_COMPARED_SQL = f"""{_COUNTS_SQL}, w AS (SELECT s.*, least(10, par) AS parallelism, p_partkey AS ord, [{", ".join(f"'{x}'" for x in _LEVELS)}][p_partkey % 4 + 1] AS expertise FROM s JOIN part ON s.name = p_name || p_partkey),
l AS (SELECT name, unnest([{", ".join(f"'{m}'" for m in loadouts.COMPARED)}]) AS metric, unnest([{", ".join(f"coalesce({m}, 0)::DOUBLE" for m in loadouts.COMPARED)}]) AS value FROM w)"""


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored configurations with an order, a level of expertise and a domain."""
    key = F.col("p_partkey")
    level = F.element_at(F.array(*map(F.lit, _LEVELS)), (key % 4 + 1).cast("int"))
    more = _table(spark, sf_dir, "part").select(F.concat("p_name", "p_partkey").alias("name"), key.alias("ord"), level.alias("expertise"))
    return loadouts.profile(_scored(spark, sf_dir)).drop("ord").join(more, "name").withColumn("domains", F.array("category"))


@query(
    f"""{_COMPARED_SQL}, r AS (SELECT *, rank() OVER (PARTITION BY metric ORDER BY value DESC) AS rank, count(*) OVER (PARTITION BY metric) AS n FROM l)
SELECT name, metric, round(value, 6) AS value, rank, CAST(floor((n - rank + 1) / n::DOUBLE * 100 + 0.5::DOUBLE) AS BIGINT) AS percentile FROM r"""
)
def loadout_comparison(spark, sf_dir):
    """Rank and percentile of every configuration for each compared metric."""
    return loadouts.comparison_matrix(_compared(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query(
    f"""{_COMPARED_SQL}, f AS (SELECT * FROM w ORDER BY CASE speed WHEN 'very-fast' THEN 0 WHEN 'fast' THEN 1 ELSE 2 END, CASE WHEN speed IN ('very-fast', 'fast') THEN -ord ELSE ord END LIMIT 1),
q AS (SELECT * FROM w ORDER BY thoroughness DESC, ord LIMIT 1), bc AS (SELECT * FROM w ORDER BY cost_benefit DESC, ord LIMIT 1), g AS (SELECT * FROM w ORDER BY benchmark DESC, ord LIMIT 1),
x AS (SELECT * FROM w ORDER BY CASE expertise WHEN 'niche' THEN 0 WHEN 'expert' THEN 1 ELSE 2 END, CASE WHEN expertise IN ('niche', 'expert') THEN -ord ELSE ord END LIMIT 1),
a AS (SELECT 'speed' AS category, name AS loadout, 'Optimized for speed with ' || speed || ' performance and ' || parallelism || '/10 parallelism' AS reason, 85 AS confidence, CASE speed WHEN 'very-fast' THEN 'May sacrifice some thoroughness for speed' ELSE '' END AS tradeoffs FROM f
UNION ALL SELECT 'quality', name, 'Highest quality score: ' || CAST(floor(thoroughness + 0.5) AS BIGINT) || ' thoroughness, ' || CAST(floor(reliability + 0.5) AS BIGINT) || ' reliability', 90, CASE WHEN speed IN ('slow', 'very-slow') THEN 'Higher quality comes with longer processing time' ELSE '' END FROM q
UNION ALL SELECT 'cost', name, 'Best cost-benefit ratio: ' || CAST(floor(cost_benefit + 0.5) AS BIGINT) || '/100 efficiency score', 80, '' FROM bc
UNION ALL SELECT 'specialization', name, expertise || ' expertise in ' || category, 75, 'Limited to specific domains|May not suit general analysis' FROM x WHERE expertise <> 'generalist'
UNION ALL SELECT 'general', name, 'Highest overall benchmark score: ' || CAST(floor(benchmark + 0.5) AS BIGINT) || '/100', 95, '' FROM g)
SELECT * FROM a"""
)
def loadout_advice(spark, sf_dir):
    """The best configuration for each of five needs, and why."""
    return loadouts.advice(_compared(spark, sf_dir)).withColumn("tradeoffs", F.array_join("tradeoffs", "|"))
