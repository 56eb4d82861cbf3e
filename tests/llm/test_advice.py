"""Losses that a review found, each on a small planted case."""

from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from skein.llm.embed_dedup import near_vectors
from skein.llm import line_dedup, warc_audit
from skein.llm.line_dedup import dedup_lines
from skein.llm.suffix_dedup import remove_repeats


@pytest.mark.parametrize("planned", [2_000, 100_000, 1_000_000, 10_000_000])
def test_recall_of_vectors_keeps_with_the_planned_size(spark, planned):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((600, 64))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    cosine = np.linspace(0.9005, 0.95, 600)[:, None]
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([x, cosine * x + np.sqrt(1 - cosine**2) * y]))]
    found = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), planned_rows=planned).collect()
    assert max(r.n_links for r in found) == 1  # no pair is counted in two tables
    assert sum(r.n_links for r in found) >= 0.98 * 1200
    assert all(r.component_id in (r.vec_id, r.vec_id - 600) for r in found)


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def near_words(x, y):
    """Is one word replaced, added or dropped between two lists of different words?"""
    return abs(len(x) - len(y)) <= 1 and slow_distance(x, y) == 1


@pytest.mark.parametrize("hot", [128, 3])
@pytest.mark.parametrize("letters", ["abcdefgh", "aé"])
def test_one_edit_of_characters_and_words(spark, monkeypatch, hot, letters):
    """Every line that an earlier one is within one edit of goes, whether keys are hot or not."""
    monkeypatch.setattr(line_dedup, "HOT_LINES", hot)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(letters) for _ in range(6))
    lines = []
    for size in [8, 33]:
        for _ in range(3):
            base = [word() for _ in range(size)]
            lines.append(" ".join(base))
            for _ in range(9):
                k, what = rng.randrange(size), rng.randrange(3)
                words = list(base)
                words[k : k + 1] = [[word()], [], [words[k], word()]][what]
                lines.append(" ".join(words))
                text = lines[-1]
                at, what = rng.randrange(len(text)), rng.randrange(3)
                lines.append(text[:at] + ["", rng.choice(letters), text[at] + "x"][what] + text[at + 1 :])
    lines += [f"a line that many documents share but for its number {k:03d} of all" for k in range(0, 400, 19)]
    lines = list(dict.fromkeys(lines))
    rng.shuffle(lines)
    for word_edits in (0, 1):
        want = set()
        for j, b in enumerate(lines):
            for a in lines[:j]:
                chars = min(len(a), len(b)) >= 40 and abs(len(a) - len(b)) <= 1 and slow_distance(a, b) <= 1
                x, y = a.split(), b.split()
                if chars or word_edits and min(len(x), len(y)) >= 8 and near_words(x, y):
                    want.add(j)
                    break
        table = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
        found = {r.doc_id for r in dedup_lines(table, word_edits=word_edits).collect() if r.n_near}
        assert len(want) > 40 and found == want


def test_pipeline_drops_lines_with_replaced_words(spark, sf_dir):
    line = "the old round hill stands above a town where every morning some people walk to their work by the river"
    once, twice = line.replace("round", "pleasant"), line.replace("round", "pleasant").replace("river", "harbour")
    docs = spark.createDataFrame([(1, line, 0), (2, once + "\nsomething else", 0), (3, twice, 0)], "doc_id long, text string, n_chars long")
    kept = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, sf_dir).collect()}
    assert kept == {1: line, 2: "something else", 3: ""}


def statuses(spark, tmp_path, change):
    """Statuses by offset of two replicas of one file, the second with its records changed."""
    bodies = [f"body {k} " + "x" * (k % 7) for k in range(40)]
    whole = [(warc_audit.VERSION + "WARC-Type: resource\r\n\r\n" + b + warc_audit.RECORD_END).encode() for b in bodies]
    read = []
    for name, records in (("a", whole), ("b", change(list(whole)))):
        folder = tmp_path / name / "file=000000-000000"
        folder.mkdir(parents=True)
        (folder / "part").write_bytes(b"".join(records))
        read.append(warc_audit.read_archive(spark, str(tmp_path / name)).cache())
    offsets = {sum(map(len, whole[:k])): k for k in range(40)}
    assert {r.offset: r.length for r in read[0].collect()} == {o: len(whole[k]) for o, k in offsets.items()}
    trees = [warc_audit.tree(r, levels=warc_audit.depth(10_000)) for r in read]
    found = warc_audit.compare(*read, warc_audit.audit(*trees)).collect()
    return {(offsets[r.offset] if r.status != "added" else "new", r.status) for r in found}


def test_fixity_of_swaps_copies_and_shifts(spark, tmp_path):
    swap = lambda r: r[:5] + [r[6], r[5]] + r[7:]
    twice = lambda r: r + [r[3]]
    second = lambda r: r[:39] + [r[39], r[39].replace(b"body", b"bodz")]
    flip = lambda r: r[:9] + [r[9].replace(b"body", b"bodz")] + r[10:]
    longer = lambda r: r[:37] + [r[37].replace(b"body", b"a body")] + r[38:]
    lost = lambda r: r[:36] + r[37:]
    assert statuses(spark, tmp_path / "0", lambda r: r) == set()
    assert statuses(spark, tmp_path / "1", swap) == {(5, "moved"), (6, "moved")}
    assert statuses(spark, tmp_path / "2", twice) == {("new", "added")}
    assert statuses(spark, tmp_path / "3", second) == {("new", "added")}
    assert statuses(spark, tmp_path / "4", flip) == {(9, "damaged")}
    assert statuses(spark, tmp_path / "5", longer) == {(37, "damaged"), (38, "moved"), (39, "moved")}
    assert statuses(spark, tmp_path / "6", lost) == {(36, "missing"), (37, "moved"), (38, "moved"), (39, "moved")}


def test_op8_statuses(spark, sf_dir):
    rows = warc_audit.op8_fixity_audit(spark, sf_dir).collect()
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    assert sum(r.status != "added" for r in rows) == pages
    assert all(r.page_id is not None for r in rows if r.status != "added")


def test_repeats_wider_than_the_default_depth(spark):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    head, width = text(90), 150  # many strings share more than 64 bytes
    tails = [text(90) for _ in range(40)]
    docs = [(k, text(20) + "".join(head + rng.choice(tails) for _ in range(6)) + text(20)) for k in range(60)]
    first, want = {}, {}
    for k, t in docs:
        for a in range(len(t) - width + 1):
            first.setdefault(t[a : a + width], k)
    for k, t in docs:
        gone = set()
        for a in range(len(t) - width + 1):
            if first[t[a : a + width]] < k:
                gone.update(range(a, a + width))
        want[k] = len(gone)
    found = remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), width=width).collect()
    assert {r.doc_id: r.n_removed for r in found} == want and sum(want.values()) > 0
    with pytest.raises(ValueError):
        remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), width=3)
