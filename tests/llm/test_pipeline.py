"""Each stage of the pipeline on what the stage before it kept, against a plain version."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skein.llm import toxicity
from tests.llm.test_contracts import shingle_groups
from tests.llm.test_decontaminate import plain_hits


def one_edit(a, b):
    """Do two different sequences differ by one replaced, added or dropped unit?"""
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k + 1 :] == b[k:] if len(a) > len(b) else a[k:] == b[k + 1 :]


def plain_lines(docs):
    """Texts by doc_id without lines that equal or are near an earlier one."""
    first, out = {}, {}
    for doc_id, text in docs:
        for line in (text or "").split("\n"):
            if line.strip(" "):
                first.setdefault(line, len(first))
    lines = list(first)
    by_size, by_words = {}, {}
    for k, line in enumerate(lines):
        by_size.setdefault(len(line), []).append(k)
        by_words.setdefault(len(line.split()), []).append(k)
    late = set()
    for k, line in enumerate(lines):
        words = line.split()
        chars = len(line) >= 40 and any(j < k and one_edit(lines[j], line) for n in (-1, 0, 1) if len(line) + n >= 40 for j in by_size.get(len(line) + n, ()))
        if chars or len(words) >= 8 and any(j < k and one_edit(lines[j].split(), words) for n in (-1, 0, 1) if len(words) + n >= 8 for j in by_words.get(len(words) + n, ())):
            late.add(line)
    seen = set()
    for doc_id, text in docs:
        kept = []
        for line in (text or "").split("\n"):
            if line.strip(" ") and (line in seen or line in late):
                continue
            seen.add(line)
            kept.append(line)
        out[doc_id] = "\n".join(kept)
    return out


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """What each stage was given and what it kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        kept = corpus_pipeline.saved(stage(spark, docs, sf_dir), name)
        out[name] = (docs, kept)
        docs = kept
    return out


def texts(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_columns_and_order(stages):
    assert list(stages) == ["toxicity", "lines", "near_duplicates", "decontamination", "packing"]
    for name, (docs, kept) in stages.items():
        if name != "packing":
            assert kept.columns == docs.columns


def test_lines_stage(stages):
    docs, kept = stages["lines"]
    assert dict(texts(kept)) == plain_lines(texts(docs))
    assert all(r.n_chars == len(r.text or "") for r in kept.collect())


def test_near_duplicates_stage(stages):
    docs, kept = stages["near_duplicates"]
    rows = texts(docs)
    _, group = shingle_groups([(d, t or "") for d, t in rows], 5, 80)
    assert texts(kept) == [(d, t) for d, t in rows if group[d] == d]


def test_decontamination_stage(spark, stages, sf_dir):
    docs, kept = stages["decontamination"]
    rows = texts(docs)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bad = {d for d, _ in plain_hits(rows, items)}
    assert texts(kept) == [(d, t) for d, t in rows if d not in bad]


def test_packing_stage(stages):
    docs, packed = stages["packing"]
    rows = packed.collect()
    assert {r.doc_id for r in rows} == {d for d, _ in texts(docs)}
    filled = {}
    for r in rows:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in filled.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *[n for _, n in parts[:-1]]]).tolist() and sum(n for _, n in parts) <= 2048


def test_toxicity_stage(spark, stages, sf_dir):
    docs, kept = stages["toxicity"]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = {r.doc_id: r.p_toxic for r in toxicity.toxicity(docs, labels).collect()}
    assert {d for d, _ in texts(kept)} == {d for d, p in scored.items() if p < toxicity.THRESHOLD}


ODD = "doc_id long, text string, row long, doc string, id int, _doc string, _home int, n_lines int, text_key long, label string"
LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


def test_stages_of_odd_rows(spark, sf_dir):
    """Nulls, empty and very long texts, repeated rows and columns with names that the operators use."""
    texts = [LONG, None, "", "x " * 40_000, LONG + " fifteen", LONG]
    rows = [(k, t, 7, "doc", 1, "d", 2, 3, 4, "l") for k, t in enumerate(texts)] + [(0, LONG, 7, "doc", 1, "d", 2, 3, 4, "l"), (None, "b", 7, "doc", 1, "d", 2, 3, 4, "l")]
    kept = {"toxicity": 8, "lines": 8, "near_duplicates": None, "decontamination": 8}
    for docs, empty in ((spark.createDataFrame(rows, ODD), False), (spark.createDataFrame([], ODD), True)):
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, docs, sf_dir).collect()
            if empty:
                assert found == []
            elif name != "packing":
                assert set(found[0].asDict()) == set(docs.columns)
                assert all((r.row, r.doc, r.id, r._doc, r._home, r.n_lines, r.text_key, r.label) == (7, "doc", 1, "d", 2, 3, 4, "l") for r in found)
                assert kept[name] is None or len(found) == kept[name]
                if name == "near_duplicates":  # copies of 0 and its near copy go, one of the equal rows stays
                    assert sorted((r.doc_id is None, r.doc_id or 0) for r in found) == [(False, 0), (False, 1), (False, 2), (False, 3), (True, 0)]
            else:
                assert {r.doc_id for r in found} == {0, 1, 2, 3, 4, 5, None}


def test_toxicity_of_held_out_documents(spark):
    """Fitted on half of the labels, the chain tells the other half."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    half = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(2))
    models = toxicity.train(docs, labels.where(half == 0), toxicity.CATEGORIES)
    scored = toxicity.score(docs.join(labels.where(half == 1).select("doc_id"), "doc_id"), models, toxicity.CATEGORIES)
    rows = scored.join(labels, "doc_id").select("p_toxic", "toxic").collect()
    hit = [(r.p_toxic >= toxicity.THRESHOLD) == (r.toxic == 1) for r in rows]
    caught = [r.p_toxic >= toxicity.THRESHOLD for r in rows if r.toxic == 1]
    assert len(rows) > 1500 and np.mean(hit) >= 0.95 and np.mean(caught) >= 0.7


def test_fit_is_at_the_optimum():
    """No weight of a fitted model has a gradient left."""
    rng = np.random.default_rng(1)
    n, width = 300, 40
    has = rng.random((n, width)) < 0.2
    label = (rng.random(n) < 1 / (1 + np.exp(-(has @ rng.normal(size=width))))).astype(float)
    earlier = rng.random((n, 1))
    row, word = np.nonzero(has)
    model = toxicity.fit(toxicity.Rows(row, word, n), label, earlier)
    gap = 1 / (1 + np.exp(-(model.intercept + has[:, model.words] @ model.weights + earlier @ model.earlier))) - label
    assert np.abs(has[:, model.words].T @ gap + toxicity.L2 * model.weights).max() < 1e-3
    assert abs(gap.sum()) < 1e-2
