"""Registered queries over research configurations and report figures, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import importance
from skein.operators import loadouts, research
from skein.plans.queries import _COUNTS_SQL, _scored, _table, query

_MORE_SQL = (
    _COUNTS_SQL
    + """, more AS (SELECT s.*, p_partkey AS ord, p_partkey % 10 / 10.0::DOUBLE AS threshold, CASE WHEN p_partkey % 3 = 0 THEN p_size * 64.0::DOUBLE END AS max_memory
  FROM s JOIN part ON s.name = p_name || p_partkey)"""
)
_FOLDERS = ["", "src/", "src/a/", "lib/x/y/"]
_NAMES = ["README.md", "package.json", "tsconfig.json", "index.ts", "index.js", "Main.TS", "app.ts", "server.js", "view.tsx", "widget.jsx", "data.json", "notes.txt", "main.ts"]
_SECTIONS = ["executive_summary", "technical_analysis", "strategic_guidance", "risk_assessment", "metrics", "appendix"]
_AREAS = ["TypeScript", "security", "technical_debt", "databases", "Frontend", "threat"]


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _chosen(values: list[str], bits: Column) -> Column:
    """Those of ``values`` whose bit is set."""
    return F.array_compact(F.array(*[F.when(F.shiftright(bits, k).bitwiseAND(F.lit(1)) == 1, F.lit(v)) for k, v in enumerate(values)]))


def _chosen_sql(values: list[str], bits: str) -> str:
    return f"list_filter({_list(values)}, lambda v, i: (({bits}) >> (i - 1)) % 2 = 1)"


@query(
    f"""WITH f AS (SELECT p_partkey AS id, {_list(_FOLDERS)}[p_partkey % 4 + 1] || {_list(_NAMES)}[p_partkey % 13 + 1] AS path FROM part),
n AS (SELECT *, length(path) - length(replace(path, '/', '')) AS slashes, lower(regexp_extract(path, '[^/]*$')) AS base FROM f)
SELECT id, path, CAST(CASE WHEN path LIKE '%.ts' OR path LIKE '%.tsx' THEN 10 WHEN path LIKE '%.js' OR path LIKE '%.jsx' THEN 8 WHEN path LIKE '%.json' THEN 5 ELSE 0 END
  + CASE WHEN slashes = 0 THEN 5 ELSE 0 END + CASE WHEN base IN ('package.json', 'tsconfig.json', 'index.ts', 'index.js', 'main.ts', 'main.js') THEN 15 ELSE 0 END + greatest(0, 10 - slashes) AS INTEGER) AS score FROM n"""
)
def file_importance(spark, sf_dir):
    key = F.col("p_partkey")
    path = F.concat(F.element_at(F.array(*map(F.lit, _FOLDERS)), (key % 4 + 1).cast("int")), F.element_at(F.array(*map(F.lit, _NAMES)), (key % 13 + 1).cast("int")))
    return _table(spark, sf_dir, "part").select(key.alias("id"), path.alias("path")).withColumn("score", importance(F.col("path")))


_PROFILE = ["parallelism", "iteration_efficiency", "convergence_speed", "runtime_minutes", "memory_mb", "fastest_minutes", "slowest_minutes", "convergence_minutes"]


@query(
    f"""{_MORE_SQL}, x AS (SELECT *, least(10, par)::DOUBLE AS parallelism, greatest(1, 10 - it)::DOUBLE AS iteration_efficiency, threshold * 10 AS convergence_speed,
  greatest(1.0::DOUBLE, 2.0::DOUBLE * it * ea / par) AS runtime_minutes, coalesce(nullif(max_memory, 0), ea * 256)::DOUBLE AS memory_mb,
  minutes * 0.7::DOUBLE AS fastest_minutes, minutes * 2 AS slowest_minutes, minutes * threshold AS convergence_minutes FROM more)
SELECT name, CASE WHEN ea <= 2 AND par <= 2 THEN 'low' WHEN ea <= 4 AND par <= 4 THEN 'moderate' WHEN ea <= 6 AND par <= 6 THEN 'high' ELSE 'very-high' END AS intensity,
  CAST(3000 * ea * it AS BIGINT) AS token_usage, CAST(least(10, ea + es + par) AS BIGINT) AS cpu_score, {", ".join(f"round({c}, 6) AS {c}" for c in _PROFILE)} FROM x"""
)
def loadout_profile(spark, sf_dir):
    out = loadouts.profile(_scored(spark, sf_dir))
    return out.select("name", "intensity", "token_usage", F.col("cpu_score").cast("long").alias("cpu_score"), *[F.round(F.col(c).cast("double"), 6).alias(c) for c in _PROFILE])


_SUGGESTED_SQL = " || ".join(
    f"CASE WHEN {test} THEN '|{text}' ELSE '' END"
    for test, text in zip(["least(10, par) < 3 AND ea > 2", "it > 4 AND reliability < 70", "tokens > 50000 AND thoroughness < 80", "speed = 'very-slow' AND thoroughness < 90"], loadouts.SUGGESTIONS, strict=True)
)


@query(
    f"""{_MORE_SQL} SELECT name, round(thoroughness / (tokens / 1000.0::DOUBLE), 6) AS per_token, round(thoroughness / minutes, 6) AS per_minute,
  round((thoroughness + reliability) / (tokens / 1000.0::DOUBLE + minutes), 6) AS per_both, ltrim({_SUGGESTED_SQL}, '|') AS suggestions FROM more"""
)
def loadout_efficiency(spark, sf_dir):
    out = _scored(spark, sf_dir).withColumn("suggestions", F.array_join(loadouts.suggestions(), "|"))
    return out.select("name", *[F.round(c, 6).alias(c) for c in ("per_token", "per_minute", "per_both")], "suggestions")


def _outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    output = F.struct(
        F.when(key % 11 != 0, _chosen(_SECTIONS, key)).alias("sections"),
        F.when(key % 5 != 0, key % 2 == 0).alias("includeDebateTopics"),
        F.when(key % 7 == 0, "swarm_consumption").otherwise("reading").alias("optimizeFor"),
        F.when(key % 3 != 0, (F.col("p_size") * 100).cast("int")).otherwise(0).alias("densityTarget"),
    )
    return _table(spark, sf_dir, "part").select(F.concat("p_name", "p_partkey").alias("name"), output.alias("output"))


@query(
    f"""WITH o AS (SELECT p_name || p_partkey AS name, p_partkey AS k, CASE WHEN p_partkey % 11 <> 0 THEN {_chosen_sql(_SECTIONS, "p_partkey")} ELSE [] END AS s,
  coalesce(CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 2 = 0 END, false) AS debate, p_size FROM part), t AS (SELECT *, array_to_string(s, ' ') AS j FROM o)
SELECT name, contains(j, 'executive') OR contains(j, 'summary') AS executive_summary, contains(j, 'technical') OR contains(j, 'analysis') AS technical_analysis,
  contains(j, 'strategic') OR contains(j, 'strategy') AS strategic_guidance, contains(j, 'risk') AS risk_assessment, debate AS debate_framework, CAST(len(s) AS INTEGER) AS sections,
  CAST(least(100, len(s) * 12) AS INTEGER) AS comprehensiveness, CAST(CASE WHEN k % 7 = 0 THEN 100 WHEN debate THEN 75 ELSE 25 END AS INTEGER) AS debate_readiness,
  CAST(CASE WHEN k % 3 <> 0 THEN p_size * 100 ELSE 3000 END AS INTEGER) AS density FROM t"""
)
def loadout_output(spark, sf_dir):
    return loadouts.output_profile(_outputs(spark, sf_dir))


def _specialists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two agents and a stage for each part, with focus areas by the bits of its key."""
    key = F.col("p_partkey")
    agent = lambda bits, on: F.struct(on.alias("enabled"), F.when(key % 4 != 0, _chosen(_AREAS, bits)).alias("specialization"))
    return _table(spark, sf_dir, "part").select(
        F.concat("p_name", "p_partkey").alias("name"),
        F.array(agent(key, key % 3 != 0), agent(F.shiftright(key, 3), F.lit(True)), agent(key * 0, key % 5 == 0)).alias("agents"),
        F.array(F.struct(F.when(key % 6 == 0, F.array(F.lit("refactoring"))).alias("focusAreas"))).alias("stages"),
    )


_SPECIAL_SQL = f"""WITH a AS (SELECT p_name || p_partkey AS name, p_partkey AS k, CASE WHEN p_partkey % 4 <> 0 THEN {_chosen_sql(_AREAS, "p_partkey")} ELSE [] END AS one,
  CASE WHEN p_partkey % 4 <> 0 THEN {_chosen_sql(_AREAS, "p_partkey >> 3")} ELSE [] END AS two, CASE WHEN p_partkey % 6 = 0 THEN ['refactoring'] ELSE [] END AS stage FROM part),
f AS (SELECT *, list_concat(list_concat(one, list_filter(two, lambda x: NOT list_contains(one, x))), stage) AS areas, (len(one) > 0)::INTEGER + (len(two) > 0)::INTEGER AS special,
  1 + (k % 3 <> 0)::INTEGER + (k % 5 = 0)::INTEGER AS enabled FROM a),
d AS (SELECT *, list_filter(['software-development', 'security', 'code-quality'], lambda x: len(list_intersect(list_transform(areas, lambda y: lower(y)),
  CASE x WHEN 'security' THEN ['security', 'vulnerabilities', 'threat'] WHEN 'code-quality' THEN ['refactoring', 'technical_debt', 'code_quality'] ELSE ['typescript', 'javascript', 'frontend', 'backend'] END)) > 0) AS domains FROM f)"""


@query(
    f"""{_SPECIAL_SQL} SELECT name, array_to_string(areas, ',') AS focus_areas, CASE WHEN len(domains) = 0 THEN 'general' ELSE array_to_string(domains, ',') END AS domains,
  CASE WHEN special = 0 THEN 'generalist' WHEN special / enabled < 0.5 THEN 'specialized' WHEN special / enabled < 0.8 THEN 'expert' ELSE 'niche' END AS expertise FROM d"""
)
def loadout_specialization(spark, sf_dir):
    out = loadouts.specialization(_specialists(spark, sf_dir))
    return out.select("name", F.array_join("focus_areas", ",").alias("focus_areas"), F.array_join("domains", ",").alias("domains"), "expertise")


@query(
    f"""{_SPECIAL_SQL}, {_MORE_SQL[len("WITH ") :]}, mm AS (SELECT more.*, list_filter(['data', 'Security', 'front'], lambda w: len(list_filter(areas, lambda x: contains(lower(x), lower(w)) OR contains(lower(w), lower(x)))) > 0) AS hits
  FROM more JOIN d USING (name)),
p AS (SELECT *, CASE WHEN speed IN ('fast', 'very-fast') THEN 20 ELSE -10 END + CASE WHEN thoroughness >= 85 THEN 25 ELSE -15 END + 20.0::DOUBLE / 3 * len(hits) + 15 + benchmark * 0.3::DOUBLE AS score FROM mm),
q AS (SELECT *, row_number() OVER (ORDER BY score DESC, ord) AS place FROM p)
SELECT name, round(score, 6) AS score, CAST(least(95, greatest(60, floor(score + 0.5))) AS BIGINT) AS confidence, CASE WHEN place = 1 THEN 'best-match' ELSE 'alternative' END AS kind,
  array_to_string(list_filter([CASE WHEN speed IN ('fast', 'very-fast') THEN 'Meets speed requirement (' || speed || ')' END, CASE WHEN thoroughness >= 85 THEN 'Exceeds quality requirement (' || CAST(floor(thoroughness + 0.5) AS BIGINT) || '/100)' END,
    CASE WHEN len(hits) > 0 THEN 'Domain expertise in ' || array_to_string(hits, ', ') END, 'Fits resource budget (' || level || ')'], lambda x: x IS NOT NULL), ', ') AS reason FROM q WHERE place <= 5"""
)
def loadout_domain_recommendation(spark, sf_dir):
    areas = loadouts.specialization(_specialists(spark, sf_dir)).select("name", "focus_areas")
    scored = _scored(spark, sf_dir).join(areas, "name")
    out = loadouts.recommended(scored, speed="fast", quality="high", domains=["data", "Security", "front"], budget="moderate", top=5, order="ord")
    return out.select("name", F.round("score", 6).alias("score"), "confidence", "kind", "reason")


@query(
    f"""{_MORE_SQL}, l AS (SELECT *, least(10, par) AS parallelism FROM more)
"""
    + " UNION ALL ".join(f"SELECT * FROM (SELECT '{m}' AS metric, name FROM l ORDER BY {m} DESC, ord LIMIT 1)" for m in loadouts.COMPARED)
)
def loadout_winners(spark, sf_dir):
    return loadouts.winners(loadouts.profile(_scored(spark, sf_dir)))


@query(f"{_MORE_SQL} SELECT name, speed FROM more ORDER BY CASE speed WHEN 'very-fast' THEN 0 WHEN 'fast' THEN 1 ELSE 2 END, CASE WHEN speed IN ('very-fast', 'fast') THEN -ord ELSE ord END LIMIT 1")
def loadout_fastest(spark, sf_dir):
    return loadouts.fold_of_classes(_scored(spark, sf_dir), "speed", "very-fast", "fast").select("name", "speed")


@query(
    """WITH e AS (SELECT DISTINCT o_orderpriority AS type, o_custkey % 5 AS loadout FROM orders WHERE o_orderstatus <> 'O')
SELECT type FROM e GROUP BY type HAVING count(*) = 5"""
)
def common_types(spark, sf_dir):
    parts = _table(spark, sf_dir, "orders").select((F.col("o_custkey") % 5).alias("loadout"), F.col("o_orderpriority").alias("type"), (F.col("o_orderstatus") != "O").alias("enabled"))
    return loadouts.common_types(parts, 5)


@query(
    """WITH l AS (SELECT p_size AS a, 7 AS b, CASE WHEN p_size % 2 = 0 THEN 1 END AS c FROM part),
u AS (SELECT 'a' AS setting, count(DISTINCT a) AS n FROM l UNION ALL SELECT 'b', count(DISTINCT b) FROM l UNION ALL SELECT 'c', count(DISTINCT coalesce(c, -1)) FROM l)
SELECT setting, n AS values, n > 1 AS differs FROM u"""
)
def setting_differences(spark, sf_dir):
    size = F.col("p_size")
    return loadouts.setting_differences(_table(spark, sf_dir, "part").select(size.alias("a"), F.lit(7).alias("b"), F.when(size % 2 == 0, 1).alias("c")), ["a", "b", "c"])


@query(
    """SELECT count(*) AS total, count(*) FILTER (p_size % 3 <> 0) AS valid, count(*) FILTER (p_size % 3 = 0) AS invalid, round(avg(p_partkey % 4) FILTER (p_size % 3 <> 0), 9) AS mean_agents,
  round(avg(p_partkey % 6) FILTER (p_size % 3 <> 0), 9) AS mean_stages FROM part"""
)
def loadout_statistics(spark, sf_dir):
    key = F.col("p_partkey")
    repeated = lambda n: F.array_repeat(F.lit("x"), n.cast("int"))
    out = loadouts.statistics(_table(spark, sf_dir, "part").select((F.col("p_size") % 3 != 0).alias("is_valid"), repeated(key % 4).alias("agents"), repeated(key % 6).alias("stages")))
    return out.withColumns({c: F.round(c, 9) for c in ("mean_agents", "mean_stages")})


_FINDINGS_SQL = """f AS (SELECT l_orderkey AS run, ['technical', 'domain', 'architectural', 'strategic', 'complexity', NULL][l_linenumber % 6 + 1] AS category,
  CASE WHEN l_partkey % 5 = 0 THEN 'approach' END AS type, l_discount * 10 AS confidence, CASE WHEN l_partkey % 3 = 0 THEN l_suppkey % 11 END AS complexity, l_suppkey % 7 = 0 AS tagged, l_quantity / 5 AS risk FROM lineitem)"""


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(x) for x in ("technical", "domain", "architectural", "strategic", "complexity")], F.lit(None).cast("string"))
    return _table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run"), F.element_at(kinds, F.col("l_linenumber") % 6 + 1).alias("category"), F.when(F.col("l_partkey") % 5 == 0, "approach").alias("type"),
        (F.col("l_discount") * 10).alias("confidence"), F.when(F.col("l_partkey") % 3 == 0, F.col("l_suppkey") % 11).alias("complexity"),
        F.when(F.col("l_suppkey") % 7 == 0, F.array(F.lit("complex"))).alias("tags"), (F.col("l_quantity") / 5).alias("risk"),
    )


@query(f"WITH {_FINDINGS_SQL} SELECT run, round((avg(confidence) + least(count(*) / 10.0::DOUBLE, 1)) / 2, 9) AS convergence FROM f GROUP BY run")
def iteration_convergence(spark, sf_dir):
    return research.iteration_convergence(_findings(spark, sf_dir), "run").withColumn("convergence", F.round("convergence", 9))


_BANDS = ["buffer", "success_buffer", "mitigation", "overhead", "testing", "effort", "expertise", "rollback", "documentation", "security_review"]


@query(
    f"""WITH {_FINDINGS_SQL}, c AS (SELECT run, coalesce(avg(CASE WHEN complexity IS NULL OR complexity = 0 THEN 5 ELSE complexity END) FILTER (category = 'complexity' OR tagged OR complexity IS NOT NULL), 5) AS complexity,
  count(*) FILTER (risk >= 6) AS critical, avg(risk) AS mean_risk, count(*) FILTER (category = 'technical') > 0 AS has_security FROM f GROUP BY run)
SELECT run, round(complexity, 6) AS complexity, critical, round(mean_risk, 6) AS mean_risk, CAST(greatest(1, floor(critical * 0.3::DOUBLE)) AS BIGINT) AS allowed, CAST(CASE WHEN mean_risk > 6 THEN 4 ELSE 2 END AS INTEGER) AS downtime_hours,
  CAST(20 + CASE WHEN complexity > 7 THEN 30 ELSE 0 END + CASE WHEN critical > 2 THEN 20 ELSE 0 END AS INTEGER) AS buffer, round(least(50.0::DOUBLE, 20 + complexity * 3 + critical * 5), 6) AS success_buffer,
  critical * 10 AS mitigation, CAST(CASE WHEN complexity > 7 THEN 30 ELSE 15 END AS INTEGER) AS overhead, CASE WHEN complexity > 5 THEN 'Extended' ELSE 'Standard' END AS testing,
  CASE WHEN complexity > 7 THEN 'High' WHEN complexity > 4 THEN 'Medium' ELSE 'Low' END AS effort, CASE WHEN complexity > 7 THEN 'Senior' WHEN complexity > 4 THEN 'Intermediate' ELSE 'Junior' END AS expertise,
  CASE WHEN complexity > 7 THEN 'High' WHEN complexity > 4 THEN 'Medium' ELSE 'Low' END AS rollback, CASE WHEN complexity > 7 THEN 'Comprehensive' ELSE 'Standard' END AS documentation,
  has_security OR complexity > 6 AS security_review FROM c"""
)
def report_bands(spark, sf_dir):
    """Complexity, risks and what a report says of them, for each run."""
    found = _findings(spark, sf_dir)
    risks = research.risk_figures(found.select("run", F.when(F.col("category") == "technical", "security").alias("category"), F.col("risk").alias("score")), "run")
    both = research.mean_complexity(found, "run").join(risks, "run")
    out = both.withColumns(research.bands(F.col("complexity"), F.col("critical"), F.col("has_security")))
    return out.select("run", F.round("complexity", 6).alias("complexity"), "critical", F.round("mean_risk", 6).alias("mean_risk"), "allowed", "downtime_hours", *[F.round(c, 6).alias(c) if c == "success_buffer" else F.col(c) for c in _BANDS])


@query(f"WITH {_FINDINGS_SQL} SELECT run, round(sum(greatest(1.0::DOUBLE, least(10.0::DOUBLE, confidence * 10 - risk * 0.5::DOUBLE))), 6) AS readiness FROM f GROUP BY run")
def approach_readiness(spark, sf_dir):
    scored = _findings(spark, sf_dir).withColumn("readiness", research.readiness(F.col("confidence"), F.col("risk")))
    return scored.groupBy("run").agg(F.round(F.sum("readiness"), 6).alias("readiness"))


@query(
    f"""WITH {_FINDINGS_SQL}, s AS (SELECT run, count(*) FILTER (confidence > 0.7) AS insights, count(*) FILTER (category = 'technical') AS technical, count(*) FILTER (category = 'domain') AS domain,
  count(*) FILTER (category = 'architectural') AS architectural, count(*) FILTER (category = 'strategic' OR type = 'approach') AS approaches FROM f GROUP BY run)
SELECT *, CAST(approaches > 1 AS INTEGER) AS debate_topics, CASE WHEN approaches > 1 THEN 0.9::DOUBLE END AS importance, CASE WHEN approaches > 1 THEN 30.0::DOUBLE END AS minutes FROM s"""
)
def report_synthesis(spark, sf_dir):
    return research.synthesis(_findings(spark, sf_dir), "run")


@query("SELECT l_orderkey AS run, CAST(sum(l_linenumber % 4) AS BIGINT) AS evidence FROM lineitem GROUP BY 1")
def evidence_count(spark, sf_dir):
    items = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), F.array_repeat(F.lit("e"), F.col("l_linenumber") % 4).alias("evidence"))
    return research.evidence_count(items, "run").withColumn("evidence", F.col("evidence").cast("long"))


_RUNS_SQL = "r AS (SELECT o_orderkey AS ord, o_custkey % 40 AS batch, o_orderstatus <> 'P' AS success, CASE WHEN o_custkey % 9 <> 0 THEN (o_orderkey % 100) / 100.0::DOUBLE END AS verification, o_orderkey % 600 + 1 AS duration_ms, o_custkey % 6 AS n FROM orders)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    return _table(spark, sf_dir, "orders").select(
        key.alias("ord"), (customer % 40).alias("batch"), (F.col("o_orderstatus") != "P").alias("success"), F.when(customer % 9 != 0, key % 100 / 100).alias("verification"), (key % 600 + 1).alias("duration_ms"), (customer % 6).alias("n"),
    )


@query(
    f"""WITH {_RUNS_SQL} SELECT ord, round(least(100.0::DOUBLE, CASE WHEN success THEN 40 ELSE 0 END + CASE WHEN n > 3 THEN 20 ELSE 0 END + CASE WHEN n > 0 THEN 20 ELSE 0 END + CASE WHEN n > 1 THEN 10 ELSE 0 END
  + coalesce(least(10.0::DOUBLE, verification * 10), 0)), 6) AS quality,
  CAST(CASE WHEN n > 3 THEN 25 ELSE 0 END + CASE WHEN n >= 3 THEN 25 ELSE 0 END + CASE WHEN n - 1 >= 2 THEN 20 ELSE 0 END + CASE WHEN n > 0 THEN 15 ELSE 0 END + CASE WHEN n >= 5 THEN 15 ELSE 0 END AS INTEGER) AS completeness FROM r"""
)
def run_scores(spark, sf_dir):
    n = F.col("n")
    quality = research.quality_score(F.col("success"), n > 3, n, n - 1, F.col("verification"))
    return _runs(spark, sf_dir).select("ord", F.round(quality, 6).alias("quality"), research.completeness_score(n > 3, n, n - 1, n, n).alias("completeness"))


@query(f"WITH {_RUNS_SQL} SELECT ord, round(coalesce(verification, 0) / (duration_ms / 1000.0::DOUBLE), 6) AS balance FROM r WHERE success ORDER BY coalesce(verification, 0) / (duration_ms / 1000.0::DOUBLE) DESC, ord LIMIT 1")
def balanced_run(spark, sf_dir):
    return research.balanced(_runs(spark, sf_dir)).select("ord", F.round("balance", 6).alias("balance"))


@query(
    """SELECT run, ord, CAST(rank AS INTEGER) AS rank FROM (SELECT o_custkey AS run, o_orderkey AS ord, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 5"""
)
def top_insights(spark, sf_dir):
    items = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("ord"), "o_totalprice")
    return research.top_of_each(items, "run", "o_totalprice", "ord", 5).select("run", "ord", "rank")


_CONSTRAINTS_SQL = "c AS (SELECT o_custkey AS run, o_orderkey AS ord, CASE WHEN o_orderkey % 3 = 0 THEN 'hard' ELSE 'soft' END AS severity, CASE WHEN o_orderkey % 5 <> 0 THEN repeat('x', CAST(o_orderkey % 17 AS INTEGER)) END AS impact FROM orders)"


@query(
    f"""WITH {_CONSTRAINTS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY run, severity ORDER BY CASE WHEN severity = 'hard' THEN -length(coalesce(impact, '')) END, ord) AS rank FROM c)
SELECT run, ord, severity, CAST(rank AS INTEGER) AS rank FROM k WHERE severity = 'hard' OR rank <= 5"""
)
def ordered_constraints(spark, sf_dir):
    key = F.col("o_orderkey")
    rows = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), key.alias("ord"), F.when(key % 3 == 0, "hard").otherwise("soft").alias("severity"), F.when(key % 5 != 0, F.expr("repeat('x', cast(o_orderkey % 17 as int))")).alias("impact"))
    return research.ordered_constraints(rows, "run").select("run", "ord", "severity", "rank")


_BUDGET, _LARGEST = 4000, 1500


@query(
    f"""WITH RECURSIVE s AS (SELECT o_custkey AS run, o_orderkey AS ord, 's' || o_orderkey AS title, o_orderkey % 7 = 0 AS executive, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority, CAST(floor(o_totalprice / 300) AS BIGINT) AS tokens FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY priority DESC, ord) AS nth FROM s),
e AS (SELECT run, title, tokens FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY nth) AS k FROM n WHERE executive) WHERE k = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY nth) AS k FROM n WHERE NOT executive),
w AS (
  SELECT r.run, CAST(0 AS BIGINT) AS k, coalesce(e.tokens, 0) AS used, false AS done, CAST(NULL AS VARCHAR) AS title, CAST(0 AS BIGINT) AS tokens, false AS cut, false AS kept FROM (SELECT DISTINCT run FROM s) r LEFT JOIN e USING (run)
  UNION ALL
  SELECT w.run, o.k, used + CASE WHEN fits THEN o.tokens WHEN cuts THEN {_BUDGET} - used ELSE 0 END, w.done OR cuts, CASE WHEN cuts THEN o.title || ' (Truncated)' ELSE o.title END,
    CASE WHEN fits THEN o.tokens WHEN cuts THEN {_BUDGET} - used ELSE 0 END, cuts, fits OR cuts
  FROM w JOIN o ON o.run = w.run AND o.k = w.k + 1,
    LATERAL (SELECT NOT w.done AND o.tokens <= {_BUDGET} - w.used AS fits), LATERAL (SELECT NOT w.done AND NOT fits AND w.used < 0.8 * {_BUDGET} AND {_BUDGET} - w.used > 0.3 * {_LARGEST} AS cuts)
), every AS (SELECT run, 0 AS k, title, tokens, false AS cut FROM e UNION ALL SELECT run, k, title, tokens, cut FROM w WHERE kept)
SELECT run, CAST(row_number() OVER (PARTITION BY run ORDER BY k) - 1 AS INTEGER) AS place, title, tokens, cut FROM every"""
)
def section_budget(spark, sf_dir):
    key = F.col("o_orderkey")
    sections = _table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("run"), key.alias("ord"), F.concat(F.lit("s"), key).alias("title"), F.when(key % 7 == 0, "executive").otherwise("other").alias("category"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.floor(F.col("o_totalprice") / 300).cast("long").alias("tokens"),
    )
    return research.within_budget(sections, "run", _BUDGET, _LARGEST)
