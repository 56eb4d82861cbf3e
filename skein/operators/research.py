"""Findings of research runs: risks, mitigations, convergence and what reports are made from.

Rows with a null key form a group of their own; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def risk_by_category(risks: DataFrame) -> DataFrame:
    """``risks(category, risk, score)``: number, mean and the highest one (the smallest name among ties)."""
    top = F.min(F.struct((-F.col("score")).alias("s"), F.col("risk"))).getField("risk")
    return risks.groupBy("category").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.count_if(F.col("score") >= 6).alias("critical"), F.count_if((F.col("score") >= 3) & (F.col("score") < 6)).alias("moderate"), top.alias("top_risk"))


def most_frequent(values: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The most frequent ``value`` of each ``key``; of equals the one seen first by ``order``."""
    counted = values.groupBy(key, value).agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))
    best = F.min(F.struct((-F.col("n")).alias("c"), F.col("first_seen"), F.col(value))).alias("b")
    return counted.groupBy(key).agg(best).select(key, F.col(f"b.{value}").alias(value), (-F.col("b.c")).alias("n"))


def convergence(findings: DataFrame, key: str = "run") -> DataFrame:
    """``findings(run, iteration, category, confidence)``: category overlap with the iteration before,
    times one minus the change of mean confidence; 0 for a first iteration."""
    each = findings.groupBy(key, "iteration").agg(F.collect_set("category").alias("cats"), F.avg("confidence").alias("mean"))
    order = Window.partitionBy(key).orderBy("iteration")
    before = each.withColumn("was", F.lag("cats").over(order)).withColumn("had", F.lag("mean").over(order))
    union = F.size(F.array_union("cats", "was"))
    overlap = F.coalesce(F.try_divide(F.size(F.array_intersect("cats", "was")), union), F.lit(0.0))  # no categories at all: none in common
    value = overlap * (1 - F.least(F.abs(F.col("mean") - F.col("had")), F.lit(1.0)))
    return before.select(key, "iteration", F.when(F.col("was").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), value)).alias("convergence"))


def within_budget(sections: DataFrame, report: str, target: int, largest: int) -> DataFrame:
    """Sections of each report in order of priority while their tokens fit ``target``.

    ``sections(<report>, ord, title, category, priority, tokens)``; a report has few sections by nature.
    The first executive section always comes first, whatever its size, and no other one comes at all.
    Sections that do not fit are passed over; while less than four fifths are used, one that is larger
    than what is left may be cut to it, if that is over three tenths of ``largest``; it is the last one.
    Of equal priorities the first by ``ord`` comes first.
    """
    kinds = "array<struct<title:string,tokens:bigint,cut:boolean>>"
    fields = F.struct((-F.col("priority")).alias("p"), "ord", "title", (F.col("category") == "executive").alias("executive"), F.col("tokens").cast("long").alias("tokens"))
    grouped = sections.groupBy(report).agg(F.sort_array(F.collect_list(fields)).alias("s"))
    first = F.slice(F.filter("s", lambda x: x["executive"]), 1, 1)
    grouped = grouped.withColumn("head", F.transform(first, lambda x: F.struct(x["title"].alias("title"), x["tokens"].alias("tokens"), F.lit(False).alias("cut"))).cast(kinds))
    used = F.coalesce(F.try_element_at("head", F.lit(1))["tokens"], F.lit(0)).cast("long")
    start = F.struct(used.alias("used"), F.lit(False).alias("done"), F.col("head").alias("kept"))

    def step(state, x):
        room = F.lit(target) - state["used"]
        fits = ~state["done"] & (x["tokens"] <= room)
        cut = ~state["done"] & ~fits & (state["used"] < 0.8 * target) & (room > 0.3 * largest)
        taken = F.when(fits, x["tokens"]).when(cut, room).otherwise(F.lit(0)).cast("long")
        entry = F.array(F.struct(F.when(cut, F.concat(x["title"], F.lit(" (Truncated)"))).otherwise(x["title"]).alias("title"), taken.alias("tokens"), cut.alias("cut")))
        return F.struct((state["used"] + taken).alias("used"), (state["done"] | cut).alias("done"), F.when(fits | cut, F.concat(state["kept"], entry)).otherwise(state["kept"]).alias("kept"))

    kept = grouped.select(report, F.aggregate(F.filter("s", lambda x: ~F.coalesce(x["executive"], F.lit(False))), start, step)["kept"].alias("kept"))
    return kept.select(report, F.posexplode("kept").alias("place", "k")).select(report, "place", "k.title", "k.tokens", "k.cut")


def cut_lines(content: Column, tokens: Column, most: Column) -> Column:
    """As many whole lines of a section as make up ``most`` of its ``tokens`` on average, and a note."""
    lines = F.split(content, "\n", -1)
    n = F.floor(F.try_divide(most, F.try_divide(tokens, F.size(lines)))).cast("int")
    return F.concat(F.array_join(F.slice(lines, F.lit(1), F.greatest(n, F.lit(0))), "\n"), F.lit("\n\n[Content truncated for brevity...]"))


def iteration_convergence(findings: DataFrame, *keys: str) -> DataFrame:
    """Of ``findings(<keys>, confidence)``: mean confidence and the share of ten findings, averaged."""
    return findings.groupBy(*keys).agg(((F.avg(F.coalesce("confidence", F.lit(0.0))) + F.least(F.count("*") / 10, F.lit(1.0))) / 2).alias("convergence"))


def mean_complexity(findings: DataFrame, *keys: str) -> DataFrame:
    """Of ``findings(<keys>, category, tags, complexity)``: mean over those that tell of complexity, five for a missing or zero one and where none does."""
    tells = F.coalesce(F.col("category") == "complexity", F.lit(False)) | F.coalesce(F.array_contains("tags", "complex"), F.lit(False)) | F.col("complexity").isNotNull()
    value = F.coalesce(F.nullif(F.col("complexity").cast("double"), F.lit(0.0)), F.lit(5.0))
    return findings.groupBy(*keys).agg(F.coalesce(F.avg(F.when(tells, value)), F.lit(5.0)).alias("complexity"))


def evidence_count(items: DataFrame, *keys: str) -> DataFrame:
    """Of ``items(<keys>, evidence array)``, insights and approaches alike."""
    return items.groupBy(*keys).agg(F.coalesce(F.sum(F.size(F.coalesce("evidence", F.array().cast("array<string>")))), F.lit(0)).alias("evidence"))


def risk_figures(risks: DataFrame, *keys: str) -> DataFrame:
    """Of ``risks(<keys>, category, score)``: critical ones, how many may stay, mean, downtime band, security.

    The order in which scores are added changes the last digits of their mean, so the band is told by nine decimals of it.
    """
    critical = F.count_if(F.coalesce(F.col("score") >= 6, F.lit(False)))
    out = risks.groupBy(*keys).agg(critical.alias("critical"), F.avg("score").alias("mean_risk"), F.coalesce(F.bool_or(F.col("category") == "security"), F.lit(False)).alias("has_security"))
    return out.withColumns(
        {
            "allowed": F.greatest(F.lit(1), F.floor(F.col("critical") * 0.3)).cast("long"),
            "downtime_hours": F.when(F.coalesce(F.round("mean_risk", 9) > 6, F.lit(False)), 4).otherwise(2),
        }
    )


def bands(complexity: Column, critical: Column, has_security: Column) -> dict[str, Column]:
    """What a report says of a complexity and a number of critical risks."""
    three = lambda high, middle, low: F.when(complexity > 7, high).when(complexity > 4, middle).otherwise(low)
    return {
        "buffer": F.lit(20) + F.when(complexity > 7, 30).otherwise(0) + F.when(critical > 2, 20).otherwise(0),
        "success_buffer": F.least(F.lit(50.0), 20 + complexity * 3 + critical * 5.0),
        "mitigation": critical * 10,
        "overhead": F.when(complexity > 7, 30).otherwise(15),
        "testing": F.when(complexity > 5, "Extended").otherwise("Standard"),
        "effort": three("High", "Medium", "Low"),
        "expertise": three("Senior", "Intermediate", "Junior"),
        "rollback": three("High", "Medium", "Low"),
        "documentation": F.when(complexity > 7, "Comprehensive").otherwise("Standard"),
        "security_review": has_security | (complexity > 6),
    }


def readiness(confidence: Column, risk: Column) -> Column:
    return F.greatest(F.lit(1.0), F.least(F.lit(10.0), confidence * 10 - risk * 0.5))


def quality_score(success: Column, summary: Column, findings: Column, recommendations: Column, verification: Column) -> Column:
    """Completeness of a run: bonuses up to 100; null parts give none."""
    bonus = lambda test, n: F.when(F.coalesce(test, F.lit(False)), n).otherwise(0.0)
    checked = F.coalesce(F.least(F.lit(10.0), verification * 10), F.lit(0.0))
    return F.least(F.lit(100.0), bonus(success, 40.0) + bonus(summary, 20.0) + bonus(findings > 0, 20.0) + bonus(recommendations > 0, 10.0) + checked)


def completeness_score(summary: Column, findings: Column, recommendations: Column, debates: Column, sections: Column) -> Column:
    bonus = lambda test, n: F.when(F.coalesce(test, F.lit(False)), n).otherwise(0)
    return bonus(summary, 25) + bonus(findings >= 3, 25) + bonus(recommendations >= 2, 20) + bonus(debates > 0, 15) + bonus(sections >= 5, 15)


def balanced(runs: DataFrame, order: str = "ord") -> DataFrame:
    """The successful run with the most verification for each second, the first of equals; no time at all is endless."""
    share = F.coalesce(F.try_divide(F.coalesce("verification", F.lit(0.0)), F.col("duration_ms") / 1000), F.when(F.coalesce("verification", F.lit(0.0)) > 0, float("inf")).otherwise(float("nan")))
    # a share that is no number never wins over one that came before
    return runs.where("success").withColumn("balance", F.when(F.isnan(share), float("-inf")).otherwise(share)).orderBy(F.desc("balance"), order).limit(1)


def top_of_each(items: DataFrame, key: str, value: str, order: str, k: int) -> DataFrame:
    """The ``k`` largest ``value`` of each ``key``, of equals the first by ``order``; with their rank."""
    best = Window.partitionBy(key).orderBy(F.desc(value), order)
    return items.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def ordered_constraints(constraints: DataFrame, key: str, soft: int = 5) -> DataFrame:
    """Hard ``constraints(<key>, ord, severity, impact)`` by the length of their impact, and the first soft ones as they come."""
    length = F.length(F.coalesce("impact", F.lit("")))
    hard = constraints.where("severity = 'hard'").withColumn("rank", F.row_number().over(Window.partitionBy(key, "severity").orderBy(length.desc(), "ord")))
    others = constraints.where("severity = 'soft'").withColumn("rank", F.row_number().over(Window.partitionBy(key, "severity").orderBy("ord")))
    return hard.unionByName(others.where(F.col("rank") <= soft))


def synthesis(findings: DataFrame, key: str) -> DataFrame:
    """Of ``findings(<key>, category, type, confidence)``: sizes of what a report is made from, and whether approaches are to be debated."""
    of = lambda c: F.count_if(F.coalesce(F.col("category") == c, F.lit(False)))
    approach = F.coalesce(F.col("category") == "strategic", F.lit(False)) | F.coalesce(F.col("type") == "approach", F.lit(False))
    out = findings.groupBy(key).agg(
        F.count_if(F.coalesce(F.col("confidence") > 0.7, F.lit(False))).alias("insights"),
        of("technical").alias("technical"),
        of("domain").alias("domain"),
        of("architectural").alias("architectural"),
        F.count_if(approach).alias("approaches"),
    )
    debated = F.col("approaches") > 1
    return out.withColumns({"debate_topics": debated.cast("int"), "importance": F.when(debated, 0.9), "minutes": F.when(debated, 30.0)})
