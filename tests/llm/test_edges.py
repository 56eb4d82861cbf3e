"""Nulls, empty texts and tables, repeated rows, extra columns with clashing names."""

from __future__ import annotations

import pytest

from skein.llm.decontaminate import clean_documents, contaminated
from skein.llm.embed_dedup import near_vectors
from skein.llm.licenses import evaluate, scan_licenses, to_postfix
from skein.llm.line_dedup import dedup_lines
from skein.llm.minhash import near_duplicates, one_of_each_group
from skein.llm.packing import pack, plan_bins
from skein.llm.suffix_dedup import remove_repeats, two_stage_suffix_array
from skein.llm.toxicity import toxicity

SHAPE = "doc_id long, text string, n_words long, place long, line string, row string"
LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
ROWS = [(1, LONG, 1, 1, "x", "y"), (2, LONG, 1, 1, "x", "y"), (3, None, None, None, None, None), (4, "", 1, 1, "", ""), (5, "a", 1, 1, "x", "y"), (5, "a", 1, 1, "x", "y"), (6, LONG + " " + LONG.upper(), 0, 0, "", "")]
ITEMS = [(1, "What is the tallest of all the hills here? It is the old round hill."), (2, None), (3, "")]
OPERATORS = {
    "licenses": scan_licenses,
    "lines": dedup_lines,
    "near": lambda d: near_duplicates(d, shingle_words=2, percent=80),
    "one": lambda d: one_of_each_group(d, shingle_words=5, percent=80),
    "pack": pack,
    "repeats": remove_repeats,
    "toxicity": lambda d: toxicity(d, d.sparkSession.createDataFrame([(1, 1, 0), (2, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")),
    "benchmark": lambda d: contaminated(d, d.sparkSession.createDataFrame(ITEMS, "item_id long, text string")),
    "clean": lambda d: clean_documents(d, d.sparkSession.createDataFrame(ITEMS, "item_id long, text string")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    rows = OPERATORS[name](spark.createDataFrame(ROWS, SHAPE)).collect()
    if name != "benchmark":
        assert {r.doc_id for r in rows} == ({1, 3, 4, 5, 6} if name == "one" else {1, 2, 3, 4, 5, 6})
    assert OPERATORS[name](spark.createDataFrame([], SHAPE)).collect() == []


def linked(spark, rows):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}


def test_vectors(spark):
    found = linked(spark, [(1, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0])])
    assert found[1][:2] == found[7][:2] == (1, 1)
    assert all(found[v] == (0, v, True) for v in (3, 4, 5, 6))


@pytest.mark.parametrize("dimension", [2, 4, 16])
def test_vectors_of_extreme_sizes(spark, dimension):
    """Sizes from 1e-300 to 1e300 neither crash nor change links; recall holds in few dimensions."""
    import numpy as np

    rng = np.random.default_rng(dimension)
    x = rng.standard_normal((300, dimension))
    size = 10.0 ** rng.integers(-300, 300, 300)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    rows = [(k, v.tolist()) for k, v in enumerate(x / np.abs(x).max(axis=1, keepdims=True) * size[:, None])]
    found = {r.vec_id: r.n_links for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert all(found[k] <= links[k] for k in found) and sum(found.values()) >= 0.9 * links.sum()



def test_vectors_of_two_dimensions(spark):
    found = linked(spark, [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (7, [1.0, 0.0])])
    assert {v: found[v][:2] for v in found} == {1: (2, 1), 2: (2, 1), 7: (2, 1)}


def test_clean_drops_only_hits(spark):
    docs = spark.createDataFrame([(1, "before it " + ITEMS[0][1] + " after it"), (2, "a clean text about hills"), (3, None)], "doc_id long, text string")
    assert {r.doc_id for r in clean_documents(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).collect()} == {2, 3}


def test_expressions():
    assert to_postfix("MIT or (Apache-2.0 and BSD-3-Clause)") is not None
    assert "unparsed" in evaluate("MIT or (")[0]


def test_bins_cover_the_histogram():
    histogram = {2048: 3, 1000: 5, 700: 7, 48: 11, 1: 40}
    used: dict[int, int] = {}
    for bins, combination in plan_bins(histogram):
        assert sum(k * n for k, n in combination) <= 2048
        for k, n in combination:
            used[k] = used.get(k, 0) + bins * n
    assert used == histogram


def test_suffix_array():
    import numpy as np

    text = np.frombuffer(b"mississippi banana mississippi", dtype=np.uint8)
    order = two_stage_suffix_array(text)
    assert [bytes(text[k:]) for k in order] == sorted(bytes(text[k:]) for k in range(len(text)))


def thue_morse(n):
    out = "a"
    while len(out) < n:
        out += out.translate(str.maketrans("ab", "ba"))
    return out


def test_near_duplicates_tell_complements_apart(spark):
    """Two words that are equal under every polynomial modulo a power of two."""
    from skein.llm.minhash import near_duplicates

    word = thue_morse(4096)
    other = word.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, word), (2, other), (3, word)], "doc_id long, text string")
    found = near_duplicates(docs, shingle_words=2).collect()
    assert {r.doc_id: r.component_id for r in found} == {1: 1, 2: 2, 3: 1}


def test_prime_hashes():
    import numpy as np

    from skein.llm import textscan

    pick = np.random.default_rng(4)
    data = pick.integers(0, 3, 5000).astype(np.uint8)
    starts = pick.integers(0, 4900, 3000)
    ends = starts + pick.integers(0, 12, 3000)
    hashes = textscan.prime_hashes(data, starts, ends)
    spans = [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    assert len(set(hashes.tolist())) == len(set(spans)) == len(set(zip(spans, hashes.tolist(), strict=True)))
    # a span's hash does not depend on where it stands, nor on how long the text is
    long = np.concatenate([data[:7], data] * 3500)
    assert (textscan.prime_hashes(long[: len(data) + 7], starts + 7, ends + 7) == hashes).all()
    assert len(long) > 1 << 24 and (textscan.prime_hashes(long, starts + 7, ends + 7) == hashes).all()


def test_lines_of_many_rows_without_ids(spark):
    from pyspark.sql import functions as F

    from skein.llm.line_dedup import dedup_lines

    n = 120_000
    rows = spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("l"), "id").alias("text"))
    out = dedup_lines(rows).agg(F.sum("n_exact"), F.sum("n_near"), F.min("n_exact"), F.sum(F.length("text")), F.count("*")).first()
    assert tuple(out) == (0, 0, 0, rows.agg(F.sum(F.length("text"))).first()[0], n)


def test_items_without_ids_are_found(spark):
    from skein.llm.decontaminate import clean_documents, contaminated

    words = [f"word{k}" for k in range(60)]
    item = " ".join(words[:30]) + ". " + " ".join(words[30:50]) + "."
    items = spark.createDataFrame([(None, item), (5, item), (None, None), (6, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, item), (2, " ".join(reversed(words))), (None, "before " + item), (3, None)], "doc_id long, text string")
    found = contaminated(docs, items).collect()
    assert sorted((str(r.doc_id), str(r.item_id)) for r in found) == [("1", "5"), ("1", "None"), ("None", "5"), ("None", "None")]
    kept = clean_documents(docs, items.where("item_id IS NULL")).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["2", "3"]


def test_expressions_end_with_their_comment():
    from skein.llm.licenses import evaluate

    assert evaluate("MIT -->")[0] == {"mit"} and evaluate("(MIT OR Apache-2.0) */ int x")[0] == {"mit", "apache-2.0"}
    assert evaluate("GPL-2.0-only. See LICENSE")[0] == {"gpl-2.0-only"} and evaluate('GPL-2.0+"')[0] == {"gpl-2.0+"}
    assert "unparsed" in evaluate("MIT Apache-2.0")[0] and "unparsed" in evaluate("-->")[0] and "unparsed" in evaluate("MIT OR -->")[0]
    assert evaluate("GPL-2.0-only WITH Classpath-exception-2.0 -->")[0] == {"gpl-2.0-only-with-classpath-exception-2.0"}
