"""Which lists and pairs the search for near documents makes."""

from __future__ import annotations

import numpy as np

from skein.llm import minhash
from skein.llm.storage import Scope


def test_lists_have_two_members_that_list_the_value(spark):
    lows = spark.createDataFrame([(1, [1, 2]), (2, [1, 3]), (3, [2, 4]), (4, [7, 8]), (5, [7, 8])], "node long, low array<long>")
    lists = minhash.listed_values(lows, Scope(spark), index_k=32, percent=80).collect()
    assert sorted((r.value, r.node, r.members) for r in lists) == [(7, 4, 2), (7, 5, 2)]


def test_pairs_are_estimated_once_and_where_sizes_allow(spark, monkeypatch, sf_dir):
    rows, whole = {}, Scope.saved

    def saved(self, df, label):
        out = whole(self, df, label)
        if label in ("voted", "alike", "met"):
            rows.setdefault(label, []).extend(tuple(sorted((r.a, r.b))) for r in out.collect())
        return out

    monkeypatch.setattr(Scope, "saved", saved)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert minhash.near_duplicates(docs, shingle_words=2).count() == docs.count()
    assert rows["voted"] and not set(rows["met"]) & set(rows["voted"])
    assert set(rows["alike"]) < set(rows["voted"])


def test_documents_that_share_a_passage_are_told_without_their_sketches(spark, monkeypatch):
    """Documents of phrases from one pool, so all values are in some other document too; each has one near copy."""
    pairs, whole = {}, Scope.saved

    def saved(self, df, label):
        out = whole(self, df, label)
        if label in ("alike", "met"):
            pairs.setdefault(label, set()).update((min(r.a, r.b), max(r.a, r.b)) for r in out.collect())
        return out

    monkeypatch.setattr(Scope, "saved", saved)
    rng, rows = np.random.default_rng(1), []
    for k in range(120):
        phrases = [f"p{p}x{j}" for p in rng.choice(480, 20, replace=False) for j in range(10)]
        rows += [(2 * k, " ".join(phrases)), (2 * k + 1, " ".join(phrases) + " more")]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=2, star_rounds=0).collect()
    assert {r.doc_id: r.component_id for r in out} == {i: i - i % 2 for i, _ in rows}
    assert len(pairs["met"]) < 1_000  # 4,698 by sizes alone


def test_masks_never_tell_of_more_values_than_are_lacking():
    rng = np.random.default_rng(1)
    for most in (60, 1_000):  # each value on a bit of its own, and some values on one bit
        lows = [np.sort(rng.choice(most, n, replace=False)).astype(np.int64) for n in rng.integers(0, 33, 100)]
        bits = np.stack(minhash.masks(lows)).view(np.uint64)
        for a, x in enumerate(lows):
            for b, y in enumerate(lows):
                lacking, told = len(np.setdiff1d(x, y)), np.bitwise_count(bits[:, a] & ~bits[:, b]).sum()
                assert told <= lacking and (told == lacking or most > minhash.MASK_BITS)
