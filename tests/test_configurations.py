"""Configuration files of the shipped shapes: figures, validation, and what is missing."""

from __future__ import annotations

import json

import pytest

from skein.operators import loadouts
from skein.sources import loadouts as files

#: Counts and settings of the five shipped configurations, and what has to come out.
SHIPPED = [
    # name, folder, agents, stages, layers, dependencies, options, iterations, parallel, threshold, sections, density, with areas
    (("Deep Intelligence Gathering", "core", 4, 4, 4, 5, 31, 4, 3, 0.85, 8, 5000, 3), (80.5, "moderate", 100, 100, 25, 49000, 8.0, 5.2394, "intensive", "expert", 59.975)),
    (("Quick Overview", "core", 3, 3, 2, 3, 23, 2, 5, 0.7, 4, 2000, 2), (57.75, "very-fast", 65, 60, 16, 20000, 1.8, 13.2946, "intensive", "expert", 59.9125)),
    (("Security-Focused Analysis", "specialized", 4, 4, 4, 6, 36, 3, 2, 0.85, 9, 4000, 3), (83.0, "moderate", 100, 100, 25, 38000, 9.0, 5.1866, "moderate", "expert", 60.85)),
    (("TypeScript Deep Analysis", "specialized", 4, 4, 4, 5, 32, 3, 4, 0.8, 9, 4500, 3), (82.25, "fast", 100, 100, 25, 38500, 4.5, 8.6087, "intensive", "expert", 64.8875)),
    (("AI-Assisted Refactoring Analysis", "experimental", 4, 4, 4, 5, 34, 4, 3, 0.8, 9, 4200, 3), (82.0, "moderate", 100, 100, 25, 48200, 8.0, 5.2621, "intensive", "expert", 59.9)),
]
LAYERS = ["syntactic", "semantic", "cross_reference", "logical_consistency"]


def document(name, ea, es, v, dep, opts, it, par, threshold, sections, density, areas):
    """A configuration with these counts."""
    agents = [{"type": "specialist", "name": f"a{k}", "enabled": True, "weight": 0.5, "config": {}, "dependencies": []} for k in range(ea)]
    for k in range(dep):
        agents[-1 - k % 2]["dependencies"].append(f"a{k}")
    for a in agents[:areas]:
        a["config"]["specialization"] = ["risk_assessment"]
    stages = [{"name": f"s{k}", "type": "call_graph", "enabled": True, "parallel": True, "weight": 0.2, "config": {"focusAreas": ["call_paths"]}} for k in range(es)]
    left = opts - areas - es
    stages[0]["config"] |= {f"o{k}": {"deep": [k]} for k in range(left)}
    return {
        "name": name,
        "description": "d",
        "version": "1.0.0",
        "pipeline": {"maxIterations": it, "convergenceThreshold": threshold, "parallelismLevel": par, "timeoutMs": 60000, "focus": "intelligence_gathering", "outputOptimization": "swarm_handoff"},
        "agents": agents,
        "stages": stages,
        "verification": [{"type": LAYERS[k], "enabled": True, "weight": 0.5, "config": {"x": 1}} for k in range(v)],
        "output": {"format": "overview", "sections": [f"summary {k}" for k in range(sections)], "densityTarget": density, "optimizeFor": "swarm_consumption", "includeDebateTopics": True, "includeMetrics": False, "includeCitations": True},
        "performance": {"cacheResults": True, "cacheTtlMinutes": 30, "maxMemoryMb": 512, "cpuIntensive": False},
    }


@pytest.fixture
def shipped(spark, tmp_path):
    yaml = pytest.importorskip("yaml")
    for k, ((name, folder, *counts), _) in enumerate(SHIPPED):
        (tmp_path / folder).mkdir(exist_ok=True)
        whole = document(name, *counts)
        text = json.dumps(whole) if k == 4 else yaml.safe_dump(whole)
        (tmp_path / folder / f"f{k}.{'json' if k == 4 else 'yml'}").write_text(text)
    return files.read_loadouts(spark, str(tmp_path))


def test_shipped_figures(shipped):
    rows = {r.name: r for r in loadouts.metrics(loadouts.counts_of(shipped)).collect()}
    level = {r.name: r.expertise for r in loadouts.specialization(shipped).collect()}
    assert len(rows) == 5
    for (name, folder, *_), want in SHIPPED:
        r = rows[name]
        got = (r.complexity, r.speed, r.thoroughness, r.accuracy, r.reliability, r.tokens, r.minutes, round(r.cost_benefit, 4), r.level, level[name], r.benchmark)
        assert list(got) == [pytest.approx(w) if isinstance(w, float) else w for w in want]
        assert r.category == folder


def test_shipped_are_valid(shipped):
    assert [(r.errors, r.is_valid) for r in files.validated(shipped).collect()] == [([], True)] * 5
    assert files.in_category(shipped, "core").count() == 2
    profile = {r.name: r for r in loadouts.output_profile(shipped).collect()}["Quick Overview"]
    assert (profile.sections, profile.comprehensiveness, profile.debate_readiness, profile.executive_summary, profile.risk_assessment) == (4, 48, 100, True, False)


def errors_of(spark, *documents):
    rows = [(f"/x/{k}.json", d if isinstance(d, str) else json.dumps(d), None) for k, d in enumerate(documents)]
    out = files.validated(files.parsed(spark.createDataFrame(rows, "path string, content string, error string")))
    return [r.errors for r in out.orderBy("path").collect()]


def changed(**places):
    whole = document("n", 2, 1, 1, 0, 5, 2, 2, 0.5, 2, 600, 1)
    for place, value in places.items():
        at, *more = place.split("__")
        target = whole
        while more:
            target = target[int(at) if isinstance(target, list) else at]
            at, *more = more
        if value is KeyError:
            del target[at]
        else:
            target[at] = value
    return whole


def test_validation(spark):
    cases = {
        (): changed(),
        ("pipeline.maxIterations must be a number from 1 to 10",): changed(pipeline__maxIterations=11),
        ("pipeline.maxIterations must be a number from 1 to 10", "name must be a string"): changed(pipeline__maxIterations="2", name=3),
        ("pipeline.timeoutMs must be a number of 1000 or more",): changed(pipeline__timeoutMs=999.5),
        ("pipeline.convergenceThreshold must be a number from 0 to 1",): changed(pipeline__convergenceThreshold=None),
        ("agents[1].type must be one of intelligence_analyst, strategy_mapper, risk_analyst, intelligence_synthesizer, specialist",): changed(agents__1__type="x"),
        ("agents[0].config.temperature must be a number from 0 to 2",): changed(agents__0__config__temperature=2.5),
        ("agents[0].config.maxTokens must be a number from 100 to 8000",): changed(agents__0__config__maxTokens="100"),
        ("agents[0].dependencies must be a list of strings",): changed(agents__0__dependencies=[1]),
        ("agents[0].dependencies must be a list of strings", "agents[1].dependencies must be a list of strings"): changed(agents__0__dependencies=KeyError, agents__1__dependencies=[None]),
        ("stages[0].conditions must be an object",): changed(stages__0__conditions=[]),
        ("stages[0].conditions.runIf must be a string",): changed(stages__0__conditions={"runIf": True}),
        ("verification must be a list",): changed(verification={"semantic": {"enabled": True}}),
        ("verification[0].enabled must be a boolean",): changed(verification__0__enabled=1),
        ("output.sections must be a list of strings",): changed(output__sections="all"),
        ("agents must be a list",): changed(agents=KeyError),
        ("not valid JSON",): '{"name": ',
    }
    for want, got in zip(cases, errors_of(spark, *list(cases.values())[:10]) + errors_of(spark, *list(cases.values())[10:]), strict=True):
        assert sorted(got) == sorted(want)
    fine = changed(output__sections=[], agents=[], stages=[], verification=[])
    assert errors_of(spark, fine) == [[]]
    assert len(errors_of(spark, "{}")[0]) == 20 + 3 and len(errors_of(spark, "[]", "3", "null")[2]) == 23


def test_named_checks_and_nulls(spark):
    named = changed(verification={"semantic": {"enabled": True}, "cross_reference": {"enabled": False}, "logical_consistency": {"enabled": True}})
    nothing = {"agents": [{"enabled": True}, {"enabled": None, "config": None}], "pipeline": {"parallelismLevel": 0}}
    rows = [("/a/named.json", json.dumps(named), None), ("/b/none.json", json.dumps(nothing), None), ("/b/broken.json", "{", None), ("c.yml", None, "bad")]
    parsed = files.parsed(spark.createDataFrame(rows, "path string, content string, error string"))
    got = {r.name: r for r in loadouts.profile(loadouts.metrics(loadouts.counts_of(parsed))).collect()}
    assert (got["n"].v, got["n"].checks, got["n"].reliability) == (2, 2, 66.0)
    none = got["none"]
    assert none.ea == 1 and [none[c] for c in ("es", "v", "complexity", "thoroughness", "accuracy", "speed", "minutes", "level", "benchmark", "parallelism", "intensity")] == [None] * 9 + [0, "low"]
    assert [(r.errors, r.is_valid) for r in files.validated(parsed).where("path LIKE '%broken%' OR path = 'c.yml'").orderBy("path").collect()] == [(["not valid JSON"], False), (["bad"], False)]
    assert files.validated(parsed, strict=True).count() == 0


def test_empty(spark):
    none = files.parsed(spark.createDataFrame([], "path string, content string, error string"))
    assert files.validated(none).collect() == [] and loadouts.metrics(loadouts.counts_of(none)).collect() == []
