"""Benchmark decontamination: BM25 over an inverted index of test items, block-max WAND, overlap check.

The index holds the benchmark's items; every training passage is a query. A passage is a run of words,
twice as long as the longest item and half overlapping, so every occurrence of an item lies whole in
one passage. Impacts are BM25 weights divided by the item's score for its own text, so the threshold
is a share of a full match.

* Spark counts words and computes impacts; a shard of the index holds ``shard_postings`` postings or so,
  whatever the number of items, sorted by word and item, with the largest impact of each word and of
  each block of items in a word's list.
* A passage's words are put in the order of their largest impacts. Up to the pivot these sum to less than
  the threshold, so an item that only has such words is no hit: only the lists from the pivot on are walked, and
  of these only the blocks. A block is opened if its largest impacts, with those of the other words,
  reach the threshold; only in open blocks are items scored. All passages of a batch take each step at
  once. All items at or above the threshold are retrieved.
* A hit counts if the item's question (all but its last sentence) and its answer (the last sentence) both
  overlap with the passage. Parts of 20 words or more are compared in runs of five, from 8 words on in
  runs of three; a shorter part by its words where the other part is not as short, else in runs of five
  or as a whole.

Each shard is one more pass over the training texts, so no broadcast grows with the benchmark.

Defined results: null and empty texts and items give no hits; items that share an ``item_id`` are
separate items whose hits count for the id, once for each shard that has one, and items without an id are
found like others and reported together, without an id; repeated rows are each reported; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import textscan
from skein.llm.storage import saved

THRESHOLD = 0.6
OVERLAP = 0.6
NGRAM = 5
K1, B = 1.2, 0.75
BLOCK_ITEMS = 16
SHARD_POSTINGS = 1_000_000
#: Cells (passage, block) that are looked at together.
CELLS = 2_000_000
HITS = "doc_id long, item_id long, passages long, score double, question_overlap double, answer_overlap double"


def _hashed(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, row bounds) for runs of texts."""
    for lo, hi, offsets, data in textscan.chunks(texts):
        data = textscan.LOWER[data]
        starts, ends, rows = textscan.words(offsets, data, textscan.LEXICAL)
        yield lo, textscan.span_hashes(data, starts, ends), np.searchsorted(rows, np.arange(hi - lo + 1))


def _sentences(text: str) -> tuple[str, str]:
    """(question, answer): all but the last sentence, and the last; one sentence is both."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if p]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, text)


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    return np.unique(textscan.shingle_hashes(words, n)) if len(words) >= n else words[:0]


def gram_sizes(question: int, answer: int, ngram: int = NGRAM) -> tuple[int, int]:
    """Words in a run, for a question and an answer of so many words."""

    def size(own: int, other: int) -> int:
        if own >= 4 * ngram:
            return ngram
        if own >= 8:
            return min(3, ngram)
        return 1 if other >= 8 else max(1, min(ngram, own))

    return size(question, answer), size(answer, question)


@dataclass
class Index:
    """Inverted lists of one shard of items: words, blocks in each word's list, postings in each block."""

    item_ids: list[int | None]
    questions: list[tuple[int, np.ndarray]]  # (words in a run, runs)
    answers: list[tuple[int, np.ndarray]]
    terms: np.ndarray  # sorted word hashes
    term_max: np.ndarray
    first_block: np.ndarray  # where each word's blocks begin, and the end
    cell: np.ndarray  # word number * blocks + block, ascending
    cell_max: np.ndarray
    first_posting: np.ndarray  # where each cell's postings begin, and the end
    item: np.ndarray
    impact: np.ndarray
    blocks: int
    window: int


def build_index(items: pa.Table, postings: pa.Table, window: int, *, ngram: int = NGRAM) -> Index:
    """Of ``items(item, item_id, text)`` and ``postings(term, item, impact)``."""
    items = items.sort_by("item")
    numbers = items["item"].to_numpy()
    parts = [_sentences(t) for t in items["text"].to_pylist()]
    split = [[h[a:b] for _, h, bounds in _hashed(pa.array([p[k] for p in parts], pa.large_string())) for a, b in zip(bounds[:-1], bounds[1:], strict=True)] for k in (0, 1)]
    sizes = [gram_sizes(len(q), len(a), ngram) for q, a in zip(*split, strict=True)]
    question, answer = ([(n[k], _grams(own, n[k])) for own, n in zip(split[k], sizes, strict=True)] for k in (0, 1))
    term, item = postings["term"].to_numpy().view(np.uint64), np.searchsorted(numbers, postings["item"].to_numpy())
    order = np.lexsort((item, term))
    item, impact = item[order], postings["impact"].to_numpy()[order]
    terms, number = np.unique(term[order], return_inverse=True)
    blocks = max(1, -(-len(numbers) // BLOCK_ITEMS))
    cells, first_posting = np.unique(number * blocks + item // BLOCK_ITEMS, return_index=True)
    cell_max = np.maximum.reduceat(impact, first_posting) if len(impact) else impact
    first_block = np.searchsorted(cells, np.arange(len(terms) + 1) * blocks)
    term_max = np.maximum.reduceat(cell_max, first_block[:-1]) if len(impact) else impact
    return Index(items["item_id"].to_pylist(), question, answer, terms, term_max, first_block, cells, cell_max, np.append(first_posting, len(impact)), item, impact, blocks, window)


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, place) of every place in the ranges."""
    counts = last - first
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(counts.sum()) + np.repeat(first - (np.cumsum(counts) - counts), counts)


def passages_of(bounds: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end): every ``window`` words a passage of twice as many words begins."""
    sizes = np.diff(bounds)
    many = np.maximum(1, -(-sizes // window) - 1) * (sizes > 0)
    row, nth = _spread(np.zeros(len(many), dtype=np.int64), many)
    start = bounds[:-1][row] + nth * window
    return row, start, np.minimum(start + 2 * window, bounds[1:][row])


def retrieve(index: Index, hashes: np.ndarray, bounds: np.ndarray, threshold: float) -> Iterator[tuple[int, int, int, int, float]]:
    """All (passage start, passage end, row, item, score) at or above the threshold."""
    if not len(index.terms) or not len(hashes):
        return
    row, start, end = passages_of(bounds, index.window)
    # different index words of each passage
    at = np.minimum(np.searchsorted(index.terms, hashes), len(index.terms) - 1)
    known = np.flatnonzero(index.terms[at] == hashes)
    passage, place = _spread(np.searchsorted(known, start), np.searchsorted(known, end))
    passage, term = np.divmod(np.unique(passage * len(index.terms) + at[known][place]), len(index.terms))
    # in the order of their largest impacts; the pivot is where the sum reaches the threshold
    order = np.lexsort((index.term_max[term], passage))
    term = term[order]
    heads = np.searchsorted(passage, np.arange(len(row) + 1))
    total = np.append(0, np.cumsum(index.term_max[term]))
    beyond = total[1:] - total[heads[:-1]][passage] >= threshold - 1e-9
    pivot = heads[1:] - np.append(0, np.cumsum(beyond))[heads[1:]] + np.append(0, np.cumsum(beyond))[heads[:-1]]
    before = total[pivot] - total[heads[:-1]]
    step = max(1, CELLS // index.blocks)
    live = np.flatnonzero(pivot < heads[1:])
    for part in (live[k : k + step] for k in range(0, len(live), step)):
        for p, item, score in _scored(index, term, heads, pivot, before, part, threshold):
            yield int(start[p]), int(end[p]), int(row[p]), item, score


def _scored(index: Index, term: np.ndarray, heads: np.ndarray, pivot: np.ndarray, before: np.ndarray, part: np.ndarray, threshold: float) -> Iterator[tuple[int, int, float]]:
    blocks = index.blocks
    # blocks in the lists from the pivot on
    of, pair = _spread(pivot[part], heads[part + 1])
    which, cell = _spread(index.first_block[term[pair]], index.first_block[term[pair] + 1])
    key = of[which] * blocks + index.cell[cell] % blocks
    bound = np.bincount(key, weights=index.cell_max[cell], minlength=len(part) * blocks)
    open_ = np.flatnonzero((bound > 0) & (bound + np.repeat(before[part], blocks) >= threshold - 1e-9))
    # the other words' largest impacts in the same blocks
    p, block = np.divmod(open_, blocks)
    which, cell = _cells(index, term, heads[part[p]], pivot[part[p]], block)
    bound = bound[open_] + np.bincount(which, weights=index.cell_max[cell], minlength=len(open_))
    keep = bound >= threshold - 1e-9
    p, block = p[keep], block[keep]
    # open blocks: every item's score
    which, cell = _cells(index, term, heads[part[p]], heads[part[p] + 1], block)
    inner, posting = _spread(index.first_posting[cell], index.first_posting[cell + 1])
    scores = np.bincount(which[inner] * BLOCK_ITEMS + index.item[posting] % BLOCK_ITEMS, weights=index.impact[posting], minlength=len(p) * BLOCK_ITEMS)
    for hit in np.flatnonzero(scores >= threshold - 1e-9).tolist():
        k, item = divmod(hit, BLOCK_ITEMS)
        yield int(part[p[k]]), int(block[k]) * BLOCK_ITEMS + item, float(scores[hit])


def _cells(index: Index, term: np.ndarray, first: np.ndarray, last: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range of words, cell) of the words' lists in one block for each range, where there is one."""
    which, pair = _spread(first, last)
    key = term[pair] * index.blocks + block[which]
    cell = np.minimum(np.searchsorted(index.cell, key), len(index.cell) - 1)
    there = index.cell[cell] == key
    return which[there], cell[there]


def _contained(part: np.ndarray, whole: np.ndarray) -> float:
    return float(np.isin(part, whole).mean()) if len(part) else 1.0


def impacts(items: DataFrame) -> DataFrame:
    """(term, item, impact, length) of ``items(item, text)``: BM25 weights as shares of the item's own score."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hashes, bounds in _hashed(batch["text"]):
                n = len(bounds) - 1
                of = np.repeat(np.arange(n), np.diff(bounds))
                order = np.lexsort((hashes, of))
                of, term = of[order], hashes[order]
                heads = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (term[1:] != term[:-1]))) if len(of) else of
                row = of[heads]
                yield pa.RecordBatch.from_arrays(
                    [batch["item"].slice(lo, n).take(pa.array(row, pa.int64())), pa.array(term[heads].view(np.int64)), pa.array(np.diff(np.append(heads, len(of))), pa.int64()), pa.array(np.diff(bounds)[row], pa.int64())],
                    names=["item", "term", "tf", "length"],
                )

    counted = saved(items.select("item", "text").mapInArrow(count, "item long, term long, tf long, length long"), "item-words")
    n, mean = counted.groupBy("item").agg(F.max("length").alias("length")).agg(F.count("*"), F.coalesce(F.avg("length"), F.lit(1.0))).first()
    frequent = counted.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.ln(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = counted.join(frequent, "term").withColumn("weight", idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(mean))))
    own = weighted.groupBy("item").agg(F.sum("weight").alias("own"))
    return weighted.join(own, "item").select("term", "item", (F.col("weight") / F.col("own")).alias("impact"), "length")


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    threshold: float = THRESHOLD,
    overlap: float = OVERLAP,
    ngram: int = NGRAM,
    shard_postings: int = SHARD_POSTINGS,
) -> DataFrame:
    """A row (doc_id, item_id, ...) for each document of ``docs(doc_id, text)`` and item found in it."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.length(F.trim("text")) > 0)
    items = saved(items.withColumn("item", F.monotonically_increasing_id()), "items")
    postings = saved(impacts(items), "postings")
    about = postings.agg(F.count("*").alias("n"), F.max("length").alias("longest")).first()
    shards = -(-about["n"] // shard_postings)
    shard = F.pmod(F.xxhash64("item"), F.lit(max(1, shards)))

    def scan(k: int) -> DataFrame:
        own = items.where(shard == k)
        # shard_postings or so, and their items
        index = build_index(own.toArrow(), postings.where(shard == k).join(own.select("item"), "item", "left_semi").select("term", "item", "impact").toArrow(), about["longest"], ngram=ngram)
        sent = spark.sparkContext.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in batches:
                best: dict[tuple[int, int | None], list] = {}
                for lo, hashes, bounds in _hashed(batch["text"]):
                    for a, b, row, j, score in retrieve(index, hashes, bounds, threshold):
                        shares = [_contained(grams, _grams(hashes[a:b], n)) for n, grams in (index.questions[j], index.answers[j])]
                        if min(shares) >= overlap:
                            known = best.setdefault((lo + row, index.item_ids[j]), [0, 0.0, 0.0, 0.0])
                            known[0] += 1
                            known[1:] = max(known[1:], [score, *shares])
                if best:
                    rows = pa.array([r for r, _ in best])
                    yield pa.RecordBatch.from_arrays(
                        [batch["doc_id"].take(rows), pa.array([i for _, i in best], pa.int64()), *(pa.array([v[k] for v in best.values()], t) for k, t in enumerate([pa.int64(), *[pa.float64()] * 3]))],
                        names=[c.split()[0] for c in HITS.split(", ")],
                    )

        return texts.mapInArrow(search, HITS)

    result = spark.createDataFrame([], HITS)
    for k in range(shards):
        result = result.union(scan(k))
    return result


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no item is found; a row without ``doc_id`` is judged by its text alone."""
    # whole rows travel in one column, so no name of theirs can clash
    keyed = docs.select(F.struct("*").alias("doc"), F.xxhash64("doc_id", "text").alias("row"), "text")
    hits = contaminated(keyed.select(F.col("row").alias("doc_id"), "text"), benchmark, **options).select(F.col("doc_id").alias("row")).distinct()
    return keyed.join(hits, "row", "left_anti").select("doc.*")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
