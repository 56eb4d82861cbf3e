"""How many pairs the search for near lines makes."""

from __future__ import annotations

import random

from skein.llm import line_dedup


def test_lines_that_share_half_are_not_all_paired(spark, monkeypatch):
    """A hundred lines have their first half in common: a few pairs a line, and the one near line still goes."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    shared = " ".join(word() for _ in range(6))
    tails = [[word() for _ in range(6)] for _ in range(100)]
    tails.append([*tails[50][:3], "other", *tails[50][4:]])
    docs = spark.createDataFrame([(k, f"{shared} {' '.join(t)}") for k, t in enumerate(tails)], "doc_id long, text string")
    paired, whole = [], line_dedup.saved

    def saved(df, label):
        out = whole(df, label)
        if label == "line-pairs":
            paired.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "saved", saved)
    late = [r.doc_id for r in line_dedup.dedup_lines(docs, word_edits=1).where("n_near > 0").collect()]
    assert late == [100]
    assert len(paired) == 2 and max(paired) <= 10 * len(tails)
