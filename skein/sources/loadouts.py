"""Declarative research configurations ("loadouts") from JSON or YAML files.

A row has the parsed fields, whatever of them is missing null, and ``document``, the whole file as a variant, which
validation reads. ``verification`` is an array of ``(key, type, enabled, weight, config)`` in both forms that files have:
as a list, whose entries have no key, and as an object, whose keys name the checks.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LAYER = "type:string,enabled:boolean,weight:double,config:map<string,string>"
SCHEMA = f"""
name string, description string, version string,
agents array<struct<name:string,type:string,enabled:boolean,weight:double,dependencies:array<string>,config:map<string,string>,tags:array<string>>>,
stages array<struct<name:string,type:string,enabled:boolean,parallel:boolean,weight:double,config:map<string,string>,conditions:struct<runIf:string,skipIf:string>>>,
verification string,
pipeline struct<maxIterations:double,convergenceThreshold:double,parallelismLevel:double,timeoutMs:double,focus:string,outputOptimization:string>,
performance struct<cacheResults:boolean,cacheTtlMinutes:double,maxMemoryMb:double,cpuIntensive:boolean>,
output struct<format:string,sections:array<string>,densityTarget:double,optimizeFor:string,includeDebateTopics:boolean,includeMetrics:boolean,includeCitations:boolean,contentTypes:array<string>>
"""

#: Kinds and ranges of the fields. A number has its range, a name its choices, ``?`` marks what may be absent.
FIELDS = {
    "name": "string",
    "description": "string",
    "version": "string",
    "pipeline.maxIterations": (1, 10),
    "pipeline.convergenceThreshold": (0, 1),
    "pipeline.parallelismLevel": (1, 10),
    "pipeline.timeoutMs": (1000, None),
    "pipeline.focus": ["intelligence_gathering", "solution_generation"],
    "pipeline.outputOptimization": ["swarm_handoff", "direct_consumption"],
    "output.format": ["intelligence_brief", "comprehensive", "overview"],
    "output.sections": "array<string>",
    "output.densityTarget": (500, 10000),
    "output.optimizeFor": ["swarm_consumption", "human_readable"],
    "output.includeDebateTopics": "boolean",
    "output.includeMetrics": "boolean",
    "output.includeCitations": "boolean",
    "performance.cacheResults": "boolean",
    "performance.cacheTtlMinutes": (1, None),
    "performance.maxMemoryMb": (256, None),
    "performance.cpuIntensive": "boolean",
}
ELEMENTS = {
    "agents": {
        "type": ["intelligence_analyst", "strategy_mapper", "risk_analyst", "intelligence_synthesizer", "specialist"],
        "name": "string",
        "enabled": "boolean",
        "weight": (0, 1),
        "config": "object",
        "config.systemPrompt": "string?",
        "config.specialization": "array<string>?",
        "config.temperature": (0, 2, "?"),
        "config.maxTokens": (100, 8000, "?"),
        "config.model": "string?",
        "dependencies": "array<string>",
    },
    "stages": {
        "name": "string",
        "type": ["domain_analysis", "technical_analysis", "strategy_analysis", "risk_analysis", "symbol_analysis", "dependency_mapping", "call_graph", "semantic_search", "type_analysis"],
        "enabled": "boolean",
        "parallel": "boolean",
        "weight": (0, 1),
        "config": "object",
        "conditions": "object?",
        "conditions.runIf": "string?",
        "conditions.skipIf": "string?",
    },
    "verification": {
        "type": ["syntactic", "semantic", "cross_reference", "logical_consistency"],
        "enabled": "boolean",
        "weight": (0, 1),
        "config": "object",
    },
}


def parsed(files: DataFrame) -> DataFrame:
    """Fields of ``files(path, content, error)``, ``content`` being JSON; what is no JSON has an error."""
    document = F.try_parse_json("content")
    rows = files.withColumn("document", document).withColumn("loadout", F.from_json("content", SCHEMA))
    broken = F.when(F.col("document").isNull(), F.lit("not valid JSON"))
    file_name = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    folder = F.regexp_extract("path", r"([^/]*)/[^/]*$", 1)
    listed = F.from_json("loadout.verification", f"array<struct<{_LAYER}>>")
    keyed = F.transform(F.map_entries(F.from_json("loadout.verification", f"map<string,struct<{_LAYER}>>")), lambda e: F.struct(e["key"].alias("key"), *[e["value"][n].alias(n) for n in ("type", "enabled", "weight", "config")]))
    plain = F.transform(listed, lambda e: F.struct(F.lit(None).cast("string").alias("key"), *[e[n].alias(n) for n in ("type", "enabled", "weight", "config")]))
    strings = lambda part, name: F.from_json(part["config"][name], "array<string>")
    agents = F.transform("loadout.agents", lambda a: a.withField("specialization", strings(a, "specialization")))
    stages = F.transform("loadout.stages", lambda s: s.withField("focusAreas", strings(s, "focusAreas")))
    verification = F.when(F.ltrim("loadout.verification").startswith("["), plain).otherwise(keyed)
    named = F.when(F.col("document").isNotNull(), F.coalesce(F.nullif("loadout.name", F.lit("")), file_name))
    return rows.select(
        "path",
        F.coalesce("error", broken).alias("error"),
        named.alias("name"),
        F.nullif(folder, F.lit("")).alias("category"),
        "loadout.description",
        F.when(F.col("document").isNotNull(), F.coalesce(F.nullif("loadout.version", F.lit("")), F.lit("0.0.0"))).alias("version"),
        agents.alias("agents"),
        stages.alias("stages"),
        verification.alias("verification"),
        "loadout.pipeline",
        "loadout.performance",
        "loadout.output",
        "document",
    )


def read_loadouts(spark: SparkSession, *folders: str) -> DataFrame:
    """One row for each configuration file, with ``error`` where it could not be parsed.

    YAML needs the ``yaml`` package on the workers; files of it have an error where that is missing. ``category`` is
    the folder that a file stands in, and a file without a name is named as the file is.
    """
    texts = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{json,yml,yaml}").load(list(folders))
    texts = texts.select("path", F.decode("content", "UTF-8").alias("content"))

    def as_json(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_yaml_as_json(text) for text in batch["content"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["path"], pa.array([x for x, _ in found], pa.string()), pa.array([e for _, e in found], pa.string())], names=["path", "content", "error"])

    is_json = F.col("path").endswith(".json")
    every = texts.where(is_json).withColumn("error", F.lit(None).cast("string")).unionByName(texts.where(~is_json).mapInArrow(as_json, "path string, content string, error string"))
    return parsed(every)


def _yaml_as_json(text: str) -> tuple[str | None, str | None]:
    """(JSON, error) of a YAML text."""
    try:
        import yaml
    except ImportError:
        return None, "the yaml package is missing"
    try:
        return json.dumps(yaml.safe_load(text), default=str), None
    except yaml.YAMLError as error:
        return None, str(error)


def in_category(loadouts: DataFrame, category: str) -> DataFrame:
    """Those whose path has a folder of this name."""
    return loadouts.where(F.col("path").contains(f"/{category}/"))


def overridden(loadouts: DataFrame, *, density: int | None = None, iterations: int | None = None, parallelism: int | None = None) -> DataFrame:
    """``loadouts`` with these settings in place of their own, where they are stated and not zero."""
    output, pipeline = F.col("output"), F.col("pipeline")
    if density:
        output = output.withField("densityTarget", F.lit(float(density)))
    if iterations:
        pipeline = pipeline.withField("maxIterations", F.lit(float(iterations)))
    if parallelism:
        pipeline = pipeline.withField("parallelismLevel", F.lit(float(parallelism)))
    return loadouts.withColumns({"output": output, "pipeline": pipeline})


def _problem(document: Column, place: str, rule) -> Column:
    """What is wrong with one field of a variant; null if nothing is. JSON's null is a value of no kind."""
    kind = F.schema_of_variant(F.try_variant_get(document, f"$.{place}", "variant"))
    if isinstance(rule, tuple):
        low, high, *may_miss = rule
        value = F.try_variant_get(document, f"$.{place}", "double")
        ok = kind.rlike("^(BIGINT|INT|DOUBLE|FLOAT|DECIMAL)") & (value >= low)
        if high is not None:
            ok &= value <= high
        said = f"a number from {low} to {high}" if high is not None else f"a number of {low} or more"
    elif isinstance(rule, list):
        may_miss, said = [], "one of " + ", ".join(rule)
        ok = (kind == "STRING") & F.try_variant_get(document, f"$.{place}", "string").isin(rule)
    else:
        may_miss, name = rule.endswith("?"), rule.rstrip("?")
        said = {"array<string>": "a list of strings", "object": "an object"}.get(name, f"a {name}")
        ok = {"array<string>": kind.isin("ARRAY<STRING>", "ARRAY<VOID>") & F.coalesce(F.size(F.try_variant_get(document, f"$.{place}", "array<string>")) >= 0, F.lit(False)), "object": kind.startswith("OBJECT<")}.get(name)
        ok = kind == name.upper() if ok is None else ok
        if name == "array<string>":
            # an empty list has no kind of elements, a list of nulls has the same one
            ok &= ~F.coalesce(F.exists(F.try_variant_get(document, f"$.{place}", "array<string>"), lambda x: x.isNull()), F.lit(False))
    fine = F.when(kind.isNull(), F.lit(bool(may_miss))).otherwise(F.coalesce(ok, F.lit(False)))
    return F.when(~fine, F.lit(f"must be {said}"))


def _problems(document: Column, rules: dict) -> Column:
    named = [(place, _problem(document, place, rule)) for place, rule in rules.items()]
    return F.array_compact(F.array(*[F.when(p.isNotNull(), F.concat(F.lit(f"{place} "), p)) for place, p in named]))


def validation_errors(document: Column | None = None) -> Column:
    """Messages for what is missing, of another kind or out of range in a ``document``; empty for a valid configuration."""
    document = F.col("document") if document is None else document
    every = [_problems(document, FIELDS)]
    for part, rules in ELEMENTS.items():
        items = F.try_variant_get(document, f"$.{part}", "array<variant>")
        every.append(F.coalesce(F.flatten(F.transform(items, _of_element(part, rules))), F.array(F.lit(f"{part} must be a list"))))
    return F.concat(*every)


def _of_element(part: str, rules: dict) -> Callable[[Column, Column], Column]:
    def problems(item: Column, i: Column) -> Column:
        return F.transform(_problems(item, rules), lambda m: F.concat(F.lit(f"{part}["), i.cast("string"), F.lit("]."), m))

    return problems


def validated(loadouts: DataFrame, *, strict: bool = False) -> DataFrame:
    """``loadouts`` with ``errors`` and ``is_valid``; a file that could not be parsed has its error alone. Strict reading leaves invalid ones out."""
    errors = F.when(F.col("error").isNotNull(), F.array("error")).otherwise(validation_errors())
    out = loadouts.withColumn("errors", errors).withColumn("is_valid", F.size("errors") == 0)
    return out.where("is_valid") if strict else out
