"""Block-max retrieval against all scores, and edited passages of items against a plain version."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest

from skein.llm import decontaminate as d


def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())


def plain_impacts(items):
    own = [words(t) for t in items]
    n, mean = len(own), sum(map(len, own)) / len(own)
    df = {w: sum(w in o for o in own) for o in own for w in o}
    out = []
    for o in own:
        w = {x: math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * o.count(x) * (d.K1 + 1) / (o.count(x) + d.K1 * (1 - d.B + d.B * len(o) / mean)) for x in set(o)}
        out.append({x: v / sum(w.values()) for x, v in w.items()})
    return out, max(map(len, own))


def plain_hits(docs, items, threshold=d.THRESHOLD, overlap=d.OVERLAP):
    """(doc, item) by scoring every item for every passage."""
    scores, window = plain_impacts([t for _, t in items])
    runs = lambda w, n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    found = set()
    for doc_id, text in docs:
        w = words(text or "")
        for start in range(0, max(1, len(w) - window), window):
            part = w[start : start + 2 * window]
            for (item_id, item), own in zip(items, scores, strict=True):
                if sum(v for x, v in own.items() if x in set(part)) < threshold - 1e-9:
                    continue
                q, a = (words(x) for x in d._sentences(item))
                shares = [len(runs(x, n) & runs(part, n)) / len(runs(x, n)) if runs(x, n) else 1.0 for x, n in zip((q, a), d.gram_sizes(len(q), len(a)), strict=True)]
                if min(shares) >= overlap:
                    found.add((doc_id, item_id))
    return found


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(400)]
    sentence = lambda n: " ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(400)], k=n))
    items = [(k, f"{sentence(rng.randrange(6, 40))}? {sentence(rng.choice([1, 3, 7, 9, 22]))}.") for k in range(120)] + [(200, "w1 w2 w3"), (201, sentence(30) + ".")]
    docs = [(k, sentence(rng.randrange(0, 400))) for k in range(60)]
    for k in range(120):
        item = rng.choice(items)[1].split(" ")
        for _ in range(rng.randrange(3)):
            item[rng.randrange(len(item))] = "changed"
        docs.append((1000 + k, f"{sentence(rng.randrange(120))} {' '.join(item)} {sentence(rng.randrange(120))}"))
    return docs + [(5000, None), (5001, "")], items


@pytest.mark.parametrize("shard_postings", [d.SHARD_POSTINGS, 700])
def test_hits_are_those_of_all_scores(spark, corpus, shard_postings):
    docs, items = corpus
    found = d.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), shard_postings=shard_postings).collect()
    want = plain_hits(docs, items)
    assert {(r.doc_id, r.item_id) for r in found} == want and len(want) > 80
    assert len(found) == len(want)


def test_edited_passages_are_found(corpus):
    """One replaced word loses few items, and no clean document is a hit."""
    docs, items = corpus
    rng = random.Random(8)
    items = [x for x in items if x[0] < 200]
    edited = []
    for k, (_, text) in enumerate(items):
        parts = text.split(" ")
        parts[rng.randrange(len(parts))] = "changed"
        edited.append((k, " ".join(parts)))
    found = plain_hits(edited, items)
    assert np.mean([(k, items[k][0]) in found for k in range(len(items))]) >= 0.9
    assert not {doc for doc, _ in plain_hits([x for x in docs if x[0] < 1000], items)}
