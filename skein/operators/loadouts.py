"""Scores of research configurations: arithmetic on their counts, ranks, and recommendations.

Every metric is a column expression over one row of counts, so scoring needs no shuffle. ``counts`` has
one row for each configuration: ``name, category, ea, es`` (enabled agents and stages), ``v``
(enabled verification layers), ``dep, opts`` (dependencies and options of enabled parts), ``it, par``
(iterations and parallelism), ``threshold, sections, density, max_memory`` and ``checks`` (how many of the
three named checks are enabled). Null counts count as missing and make what depends on them null, as does a
parallelism of zero for what is divided by it.

Checks have names where a configuration gives ``verification`` as an object; in a list they have none, so they count
as layers and not as named checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.discovery import running_within

#: Order of the speed classes, of the budgets, and least scores of the quality classes.
SPEEDS = {"very-fast": 5, "fast": 4, "moderate": 3, "slow": 2, "very-slow": 1}
BUDGETS = {"low": 1, "moderate": 2, "high": 3, "unlimited": 4}
QUALITIES = {"basic": 50, "good": 70, "high": 85, "excellent": 95}
#: Cost of a level; levels that are not listed count as moderate.
LEVEL_COST = {"low": 1, "moderate": 2, "high": 3, "very-high": 4}


def counts_of(loadouts: DataFrame) -> DataFrame:
    """Counts of parsed configurations (see ``skein.sources.loadouts``)."""
    agents, stages = F.filter("agents", lambda x: x["enabled"]), F.filter("stages", lambda x: x["enabled"])
    layers = F.filter("verification", lambda x: x["enabled"])
    options = lambda parts: F.aggregate(parts, F.lit(0), lambda n, x: n + F.coalesce(F.size(F.map_keys(x["config"])), F.lit(0)))
    keys = F.transform(layers, lambda x: x["key"])
    named = sum(F.when(F.array_contains(keys, n), 1).otherwise(0) for n in ("logical_consistency", "cross_reference", "semantic"))
    return loadouts.select(
        "name",
        "category",
        F.size(agents).alias("ea"),
        F.size(stages).alias("es"),
        F.size(layers).alias("v"),
        F.aggregate(agents, F.lit(0), lambda n, x: n + F.coalesce(F.size(x["dependencies"]), F.lit(0))).alias("dep"),
        (options(agents) + options(stages)).alias("opts"),
        F.col("pipeline.maxIterations").alias("it"),
        F.col("pipeline.parallelismLevel").alias("par"),
        F.col("pipeline.convergenceThreshold").alias("threshold"),
        F.coalesce(F.size("output.sections"), F.lit(0)).alias("sections"),
        F.coalesce(F.nullif("output.densityTarget", F.lit(0)), F.lit(3000)).alias("density"),
        named.alias("checks"),
        F.col("performance.maxMemoryMb").alias("max_memory"),
    )


def _most(x: Column, limit: float) -> Column:
    return F.when(x.isNotNull(), F.least(x, F.lit(limit)))


def _least(x: Column, limit: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(x, F.lit(limit)))


def _most_100(x: Column) -> Column:
    return _most(x.cast("double"), 100.0)


def speed_class(it: Column, par: Column) -> Column:
    return F.when(it.isNull() | par.isNull(), None).when((it <= 2) & (par >= 4), "very-fast").when((it <= 3) & (par >= 3), "fast").when((it <= 4) & (par >= 2), "moderate").when(it <= 5, "slow").otherwise("very-slow")


def intensity(ea: Column, par: Column) -> Column:
    return F.when(ea.isNull() | par.isNull(), None).when((ea <= 2) & (par <= 2), "low").when((ea <= 4) & (par <= 4), "moderate").when((ea <= 6) & (par <= 6), "high").otherwise("very-high")


def metrics(counts: DataFrame) -> DataFrame:
    """``counts`` with complexity, speed, quality, resources, efficiency and the composite score."""
    ea, es, v, it, par = (F.col(c) for c in ("ea", "es", "v", "it", "par"))
    parts = [_most_100(ea * 15 + F.col("dep") * 5), _most_100(es * 20 + par * 5), _most_100(v * 20), _most_100(F.col("opts") * 2)]
    out = counts.withColumns(
        {
            "complexity": sum(parts[1:], parts[0]) / 4,
            "speed": speed_class(it, par),
            "thoroughness": _most_100(it * 15 + v * 10 + es * 5),
            "accuracy": _most_100(v * 20 + 20),
            "comprehensiveness": _most_100(ea * 15 + F.col("sections") * 10),
            "reliability": _most_100(F.col("checks") * 25 + F.when(v >= 3, F.lit(25)).otherwise(v * 8)),
            "tokens": (ea * it * 2500 + es * 1000 + F.col("density")).cast("long"),
            "level": F.when((ea + es + par).isNull(), None).when(ea + es + par <= 5, "light").when(ea + es + par <= 10, "moderate").when(ea + es + par <= 15, "intensive").otherwise("extreme"),
            "minutes": _least(F.try_divide(it * ea * 1.5, par), 1.0),
        }
    )
    quality = (F.col("thoroughness") + F.col("reliability") + F.col("accuracy")) / 3
    composite = quality * 0.4 + _least(10 - it, 1) * 10 * 0.3 + _most(par, 10) * 10 * 0.2 + (100 - F.col("complexity") * 0.5) * 0.1
    out = out.withColumns(
        {
            "per_token": F.try_divide(F.col("thoroughness"), F.col("tokens") / 1000),
            "per_minute": F.try_divide(F.col("thoroughness"), F.col("minutes")),
            "per_both": F.try_divide(F.col("thoroughness") + F.col("reliability"), F.col("tokens") / 1000 + F.col("minutes")),
            "benchmark": _most_100(composite),
        }
    )
    return out.withColumn("cost_benefit", _most_100(F.col("per_token") * 0.3 + F.col("per_minute") * 0.3 + F.col("per_both") * 0.4))


def profile(scored: DataFrame) -> DataFrame:
    """``metrics`` with the performance and resource figures that are predicted from the counts."""
    ea, es, it, par = (F.col(c) for c in ("ea", "es", "it", "par"))
    memory = F.coalesce(F.nullif(F.col("max_memory"), F.lit(0.0)), (ea * 256).cast("double"))
    return scored.withColumns(
        {
            "parallelism": _most(par, 10),
            "iteration_efficiency": _least(10 - it, 1),
            "convergence_speed": F.col("threshold") * 10,
            "intensity": intensity(ea, par),
            "runtime_minutes": _least(F.try_divide(it * ea * 2.0, par), 1.0),
            "token_usage": (ea * 3000 * it).cast("long"),
            "memory_mb": memory,
            "cpu_score": _most(ea + es + par, 10),
            "fastest_minutes": F.col("minutes") * 0.7,
            "slowest_minutes": F.col("minutes") * 2,
            "convergence_minutes": F.col("minutes") * F.col("threshold"),
        }
    )


#: What is suggested, in this order.
SUGGESTIONS = [
    "Consider increasing parallelismLevel for better performance",
    "High iterations with low reliability - review verification settings",
    "High token usage with moderate quality - optimize agent configurations",
    "Slow performance without exceptional quality - consider simpler loadout",
]


def suggestions() -> Column:
    """Suggestions for a row of ``metrics``."""
    tests = [
        (_most(F.col("par"), 10) < 3) & (F.col("ea") > 2),
        (F.col("it") > 4) & (F.col("reliability") < 70),
        (F.col("tokens") > 50000) & (F.col("thoroughness") < 80),
        (F.col("speed") == "very-slow") & (F.col("thoroughness") < 90),
    ]
    return F.array_compact(F.array(*[F.when(t, F.lit(x)) for t, x in zip(tests, SUGGESTIONS, strict=True)]))


def output_profile(loadouts: DataFrame) -> DataFrame:
    """Of ``output`` with ``sections, includeDebateTopics, optimizeFor, densityTarget``: what a report will hold."""
    sections = F.coalesce("output.sections", F.array().cast("array<string>"))
    any_of = lambda *parts: F.exists(sections, lambda s: F.coalesce(s.rlike("|".join(parts)), F.lit(False)))
    debate = F.coalesce("output.includeDebateTopics", F.lit(False))
    return loadouts.select(
        "name",
        any_of("executive", "summary").alias("executive_summary"),
        any_of("technical", "analysis").alias("technical_analysis"),
        any_of("strategic", "strategy").alias("strategic_guidance"),
        any_of("risk").alias("risk_assessment"),
        debate.alias("debate_framework"),
        F.size(sections).alias("sections"),
        F.least(F.lit(100), F.size(sections) * 12).alias("comprehensiveness"),
        F.when(F.col("output.optimizeFor") == "swarm_consumption", 100).when(debate, 75).otherwise(25).alias("debate_readiness"),
        F.coalesce(F.nullif("output.densityTarget", F.lit(0)), F.lit(3000)).alias("density"),
    )


#: Focus areas, in lower case, that put a configuration into a domain.
DOMAINS = {
    "software-development": ["typescript", "javascript", "frontend", "backend"],
    "security": ["security", "vulnerabilities", "threat"],
    "code-quality": ["refactoring", "technical_debt", "code_quality"],
}


def specialization(loadouts: DataFrame) -> DataFrame:
    """Of ``agents(enabled, specialization)`` and ``stages(focusAreas)``: focus areas, domains and level.

    Areas of all parts count, enabled or not, in their order and each once; the level is the share of
    agents with areas of their own among the enabled ones.
    """
    none = F.array().cast("array<string>")
    areas = F.concat(F.flatten(F.transform("agents", lambda a: F.coalesce(a["specialization"], none))), F.flatten(F.transform("stages", lambda s: F.coalesce(s["focusAreas"], none))))
    low = F.transform("focus_areas", lambda x: F.lower(x))
    found = F.array_compact(F.array(*[F.when(F.arrays_overlap(low, F.array(*[F.lit(x) for x in names])), F.lit(domain)) for domain, names in DOMAINS.items()]))
    special = F.size(F.filter("agents", lambda a: F.size(F.coalesce(a["specialization"], none)) > 0))
    share = F.try_divide(special, F.size(F.filter("agents", lambda a: a["enabled"])))
    out = loadouts.withColumn("focus_areas", F.array_distinct(areas)).withColumn("_domains", found)
    # with no agent enabled the share is endless
    level = F.when(special == 0, "generalist").when(share < 0.5, "specialized").when(share < 0.8, "expert").otherwise("niche")
    return out.select("name", "focus_areas", F.when(F.size("_domains") > 0, F.col("_domains")).otherwise(F.array(F.lit("general"))).alias("domains"), level.alias("expertise"))


def domain_matches(areas: Column, wanted: list[str]) -> Column:
    """Those of the ``wanted`` domains that hold one of the areas or are held by one, in any case."""
    hit = lambda d: F.exists(areas, lambda a: F.lower(a).contains(d.lower()) | F.contains(F.lit(d.lower()), F.lower(a)))
    return F.array_compact(F.array(*[F.when(hit(d), F.lit(d)) for d in wanted]))


def ranked(scored: DataFrame, metric: str, by: str = "category") -> DataFrame:
    """Rank (ties share the first place) and percentile of a metric within each ``by``; missing values come last.

    Equal values are counted and their counts summed over ranges, so a category may hold most of the rows.
    """
    counts = scored.groupBy(F.col(by).alias("_by"), F.col(metric).alias("_value")).agg(F.count("*").alias("_c"))
    places = running_within(counts, "_c", ["_by"], [F.desc("_value")]).select("_by", "_value", (F.col("running") - F.col("_c") + 1).cast("int").alias("rank"), "total")
    found = scored.join(places, F.col(by).eqNullSafe(F.col("_by")) & F.col(metric).eqNullSafe(F.col("_value"))).drop("_by", "_value")
    share = F.floor((F.col("total") - F.col("rank") + 1) / F.col("total") * 100 + 0.5)
    return found.withColumn("percentile", share.cast("long")).drop("total")


#: The metrics of a comparison.
COMPARED = ["benchmark", "complexity", "thoroughness", "parallelism", "cost_benefit"]


def winners(scored: DataFrame, order: str = "ord") -> DataFrame:
    """(metric, name): the largest of each compared metric, of equals the first by ``order``."""
    best = [F.min_by("name", F.struct((-F.col(m).cast("double")).alias("v"), F.col(order))).alias(m) for m in COMPARED]
    return scored.agg(*best).select(F.stack(F.lit(len(COMPARED)), *[x for m in COMPARED for x in (F.lit(m), F.col(m))]).alias("metric", "name"))


def comparison_matrix(scored: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(name, metric, value, rank, percentile) of the compared metrics; equal values share the first place, missing ones are zero.

    Of ``names``, those that are there are compared. Ranks come from counts of equal values and a running sum over
    ranges of them, so a metric of all configurations is no task's alone.
    """
    chosen = scored.where(F.col("name").isin(names)) if names is not None else scored
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias("value")) for m in COMPARED])
    long = chosen.select("name", F.explode(pairs).alias("p")).select("name", "p.*")
    counts = long.groupBy("metric", "value").agg(F.count("*").alias("c"))
    ranks = running_within(counts, "c", ["metric"], [F.desc("value")])
    rank = F.col("running") - F.col("c") + 1
    share = F.floor((F.col("total") - rank + 1) / F.col("total") * 100 + 0.5)
    return long.join(ranks.select("metric", "value", rank.alias("rank"), share.cast("long").alias("percentile")), ["metric", "value"]).select("name", "metric", "value", "rank", "percentile")


def _number(x: Column) -> Column:
    """As a whole number where it is one."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def advice(scored: DataFrame, order: str = "ord") -> DataFrame:
    """(category, loadout, reason, confidence, tradeoffs): the best of ``scored(<order>, name, metrics, expertise, domains)`` for five needs.

    Of equal ones the first counts, for speed and specialisation the last of the best class. Nobody special gives no such row.
    """
    ord_, shown = F.col(order), lambda x: F.floor(x + 0.5).cast("long").cast("string")

    def top(metric: str, *fields: str) -> Column:
        return F.min_by(F.struct("name", *fields), F.struct((-F.coalesce(F.col(metric).cast("double"), F.lit(0.0))).alias("v"), ord_.alias("o")))

    def last_of(column: str, best: str, second: str, *fields: str) -> Column:
        rank = F.when(F.col(column) == best, 0).when(F.col(column) == second, 1).otherwise(2)
        return F.min_by(F.struct("name", *fields), F.struct(rank.alias("r"), F.when(rank < 2, -ord_).otherwise(ord_).alias("o")))

    best = scored.agg(
        last_of("speed", "very-fast", "fast", "speed", "parallelism").alias("s"),
        top("thoroughness", "thoroughness", "reliability", "speed").alias("q"),
        top("cost_benefit", "cost_benefit").alias("c"),
        last_of("expertise", "niche", "expert", "expertise", "domains").alias("x"),
        top("benchmark", "benchmark").alias("g"),
    )
    s, q, c, x, g = (F.col(n) for n in "sqcxg")
    none = F.array().cast("array<string>")
    said = lambda when, *texts: F.when(when, F.array(*map(F.lit, texts))).otherwise(none)
    rows = [
        ("speed", s, F.concat(F.lit("Optimized for speed with "), s["speed"], F.lit(" performance and "), _number(s["parallelism"]), F.lit("/10 parallelism")), 85, said(s["speed"] == "very-fast", "May sacrifice some thoroughness for speed")),
        ("quality", q, F.concat(F.lit("Highest quality score: "), shown(q["thoroughness"]), F.lit(" thoroughness, "), shown(q["reliability"]), F.lit(" reliability")), 90, said(q["speed"].isin("slow", "very-slow"), "Higher quality comes with longer processing time")),
        ("cost", c, F.concat(F.lit("Best cost-benefit ratio: "), shown(c["cost_benefit"]), F.lit("/100 efficiency score")), 80, none),
        ("specialization", x, F.concat(x["expertise"], F.lit(" expertise in "), F.array_join(x["domains"], ", ")), 75, said(F.lit(True), "Limited to specific domains", "May not suit general analysis")),
        ("general", g, F.concat(F.lit("Highest overall benchmark score: "), shown(g["benchmark"]), F.lit("/100")), 95, none),
    ]
    made = F.array(*[F.struct(F.lit(name).alias("category"), of["name"].alias("loadout"), reason.alias("reason"), F.lit(sure).alias("confidence"), trade.alias("tradeoffs")) for name, of, reason, sure, trade in rows])
    return best.select(F.inline(made), x["expertise"].alias("_level")).where("loadout IS NOT NULL AND (category != 'specialization' OR _level != 'generalist')").drop("_level")


def fold_of_classes(scored: DataFrame, column: str, best: str, second: str, order: str = "ord") -> DataFrame:
    """The row that a walk in ``order`` ends with, if ``best`` always replaces and ``second`` unless ``best`` was seen.

    So the last row of ``best``, else the last of ``second``, else the first row.
    """
    rank = F.when(F.col(column) == best, 0).when(F.col(column) == second, 1).otherwise(2)
    place = F.when(rank < 2, -F.col(order)).otherwise(F.col(order))
    return scored.orderBy(rank, place).limit(1)


def common_types(parts: DataFrame, loadouts: int) -> DataFrame:
    """Types of enabled ``parts(loadout, type, enabled)`` that all ``loadouts`` have."""
    return parts.where("enabled").groupBy("type").agg(F.count_distinct("loadout").alias("n")).where(F.col("n") == loadouts).select("type")


def setting_differences(loadouts: DataFrame, settings: list[str]) -> DataFrame:
    """(setting, values, differs): how many values each setting has over all rows."""
    seen = loadouts.agg(*[(F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in settings])
    told = seen.select(F.stack(F.lit(len(settings)), *[x for c in settings for x in (F.lit(c), F.col(c))]).alias("setting", "values"))
    return told.withColumn("differs", F.col("values") > 1)


def statistics(loadouts: DataFrame) -> DataFrame:
    """Totals of ``loadouts(is_valid, agents, stages)``, with the mean numbers of agents and stages of the valid ones."""
    valid = F.col("is_valid")
    return loadouts.agg(
        F.count("*").alias("total"),
        F.count_if(valid).alias("valid"),
        F.count_if(~valid).alias("invalid"),
        F.coalesce(F.avg(F.when(valid, F.size("agents"))), F.lit(0.0)).alias("mean_agents"),
        F.coalesce(F.avg(F.when(valid, F.size("stages"))), F.lit(0.0)).alias("mean_stages"),
    )


def recommended(
    scored: DataFrame, *, speed: str | None = None, quality: str | None = None, domains: list[str] | None = None, budget: str | None = None, top: int = 3, order: str = "name"
) -> DataFrame:
    """The ``top`` configurations for stated needs, with reasons and a confidence from 60 to 95.

    Of equal scores the first by ``order`` comes first. ``domains`` need the column ``focus_areas``.
    """
    points, reasons = F.lit(0.0), []

    def need(met: Column, won: Column | int, lost: int, reason: Column) -> None:
        nonlocal points
        points += F.when(met, won).otherwise(lost)
        reasons.append(F.when(met, reason))

    if speed:
        classes = F.create_map(*[F.lit(x) for kv in SPEEDS.items() for x in kv])
        need(F.coalesce(classes[F.col("speed")], F.lit(3)) >= SPEEDS.get(speed, 3), 20, -10, F.concat(F.lit("Meets speed requirement ("), "speed", F.lit(")")))
    if quality:
        shown = F.floor(F.col("thoroughness") + 0.5).cast("string")
        need(F.col("thoroughness") >= QUALITIES.get(quality, 70), 25, -15, F.concat(F.lit("Exceeds quality requirement ("), shown, F.lit("/100)")))
    if domains:
        found = domain_matches(F.col("focus_areas"), domains)
        need(F.size(found) > 0, F.size(found) * (20.0 / len(domains)), 0, F.concat(F.lit("Domain expertise in "), F.array_join(found, ", ")))
    if budget:
        cost = F.coalesce(*[F.when(F.col("level") == n, F.lit(c)) for n, c in LEVEL_COST.items()], F.lit(2))
        need(cost <= BUDGETS.get(budget, 2), 15, -10, F.concat(F.lit("Fits resource budget ("), "level", F.lit(")")))
    points += F.col("benchmark") * 0.3
    out = scored.withColumn("score", points).withColumn("reason", F.array_join(F.array_compact(F.array(*reasons)), ", ") if reasons else F.lit(""))
    out = out.withColumn("tradeoffs", F.slice(suggestions(), 1, 2)).orderBy(F.desc("score"), order).limit(top)
    # so few rows that one task may number them
    place = F.row_number().over(Window.orderBy(F.desc("score"), order))
    out = out.withColumn("kind", F.when(place == 1, "best-match").otherwise("alternative"))
    return out.withColumn("confidence", F.least(F.lit(95), F.greatest(F.lit(60), F.floor(F.col("score") + 0.5))).cast("long"))
