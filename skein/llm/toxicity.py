"""Toxicity categories by a classifier chain of linear models.

Categories are predicted one after another. Each model is a logistic regression on which words and
beginnings of words a text has, and on the probabilities of all categories before it. For training, those probabilities are
out-of-fold predictions, so a model never sees an earlier model's opinion of rows it was fitted on.

Models are fitted on a sample of at most ``sample_rows`` labelled documents (those with the smallest
hashes of their ids; equal texts count once) and hold at most ``max_features`` words each,
all of which tell more about the label than chance would over all words tried. Spark counts and
chooses the words; each model of a category, whole or with a fold left out, is fitted in a task of its
own, so the driver sees parameters and out-of-fold probabilities only. Every document is scored, over
its whole text.

Defined results: null and empty texts are scored by the intercepts; rows whose label is null are left
out of that category's training; a category with only one class gets a constant, and a fold without
any row outside it a probability of one half; without any labels all probabilities are zero; rows that
share a ``doc_id`` are scored separately; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import textscan
from skein.llm.storage import saved

CATEGORIES = ("quality", "toxic")
SAMPLE_ROWS = 20_000
MAX_FEATURES = 2_000
LEAST_DOCUMENTS = 4
SIGNIFICANCE = 0.01
#: Beginnings of words that are features besides whole words, so that inflected forms count together.
PREFIX_BYTES = (4, 5, 6)
FOLDS = 4
L2 = 0.1
THRESHOLD = 0.5
#: Bytes of text whose words a worker holds at once, and entries of a sum: the arrays made from them are many times larger.
TEXT_BYTES = 1 << 18
SUM_ENTRIES = 1 << 18
SAMPLE_BATCH = 1_000


@dataclass
class Linear:
    words: np.ndarray  # sorted word hashes
    weights: np.ndarray
    earlier: np.ndarray  # weights of the categories before
    intercept: float


@dataclass
class Rows:
    """Which words each text has: entries sorted by row."""

    row: np.ndarray
    word: np.ndarray
    n: int

    def take(self, keep: np.ndarray) -> Rows:
        number = (np.cumsum(keep) - 1).astype(self.row.dtype)
        inside = keep[self.row]
        return Rows(number[self.row[inside]], self.word[inside], int(keep.sum()))


def _margin(model: Linear, rows: Rows, earlier: np.ndarray) -> np.ndarray:
    out = np.full(rows.n, model.intercept) + earlier @ model.earlier
    if len(model.words) and len(rows.word):
        at = np.minimum(np.searchsorted(model.words, rows.word), len(model.words) - 1)
        hit = model.words[at] == rows.word
        out += np.bincount(rows.row[hit], weights=model.weights[at[hit]], minlength=rows.n)
    return out


def probability(model: Linear, rows: Rows, earlier: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_margin(model, rows, earlier), -30, 30)))


def _information(positive: Column, total: Column, n_positive: int, n: int) -> Column:
    """G statistic of each word's presence against the label."""
    parts = []
    for hit, size in ((positive, total), (n_positive - positive, n - total)):
        for count, share in ((hit, n_positive / n), (size - hit, 1 - n_positive / n)):
            parts.append(2 * count * F.ln(F.greatest(count, F.lit(1e-12)) / F.greatest(size * share, F.lit(1e-12))))
    return reduce(lambda x, y: x + y, parts)


def _telling(counts: DataFrame, positive: Column, total: Column, n: int, n_positive: int, tried: int, max_features: int, least: int) -> DataFrame:
    """Words that tell most about the label, more than chance would over all ``tried`` words."""
    # chance alone would pass the bound for one label in a hundred, over all words that are tried
    bound = 2 * math.log(max(1, tried) / SIGNIFICANCE)
    scored = counts.where(total >= least).select("word", _information(positive.cast("double"), total.cast("double"), n_positive, n).alias("score"))
    return scored.where(F.col("score") > bound).orderBy(F.desc("score"), "word").limit(max_features).select("word")


def _summed(index: np.ndarray, values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """``n`` sums of ``values[at]`` by ``index``, in the order of the entries."""
    out = np.zeros(n)
    for lo in range(0, len(index), SUM_ENTRIES):
        part = slice(lo, lo + SUM_ENTRIES)
        np.add.at(out, index[part].astype(np.intp), values[at[part]])
    return out


def fit(rows: Rows, label: np.ndarray, earlier: np.ndarray, *, l2: float = L2, iterations: int = 400) -> Linear:
    """Logistic regression on the words of ``rows``, by accelerated gradient steps."""
    n, n_positive = len(label), int(label.sum())
    none = np.zeros(0)
    if n_positive in (0, n):
        constant = 0.0 if n == 0 else -30.0 if n_positive == 0 else 30.0
        return Linear(np.zeros(0, dtype=np.int64), none, np.zeros(earlier.shape[1]), constant)
    words = np.unique(rows.word)
    row, width = rows.row, len(words)
    column = np.empty(len(row), dtype=np.int32)
    for lo in range(0, len(row), SUM_ENTRIES):
        column[lo : lo + SUM_ENTRIES] = np.searchsorted(words, rows.word[lo : lo + SUM_ENTRIES])
    weight, momentum, extra, extra_momentum = np.zeros(width), np.zeros(width), np.zeros(earlier.shape[1]), np.zeros(earlier.shape[1])
    intercept = intercept_momentum = float(np.log(n_positive / (n - n_positive)))
    # step by column: half the mass of a column bounds its curvature
    most = np.bincount(row, minlength=n).max(initial=1) + earlier.shape[1] + 1
    curvature = np.bincount(column, minlength=width) / 4 + l2
    step = 4.0 / most
    previous = 1.0
    for _ in range(iterations):
        margin = intercept_momentum + _summed(row, momentum, column, n) + earlier @ extra_momentum
        gradient = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - label
        new = momentum - step * (_summed(column, gradient, row, width) + l2 * momentum) / curvature
        new_extra = extra_momentum - step * (earlier.T @ gradient + l2 * extra_momentum) / ((earlier**2).sum(axis=0) / 4 + l2)
        new_intercept = intercept_momentum - step * gradient.sum() / (n / 4)
        now = (1 + (1 + 4 * previous**2) ** 0.5) / 2
        pull = (previous - 1) / now
        momentum, extra_momentum, intercept_momentum = new + pull * (new - weight), new_extra + pull * (new_extra - extra), new_intercept + pull * (new_intercept - intercept)
        weight, extra, intercept, previous = new, new_extra, new_intercept, now
    return Linear(words, weight, extra, float(intercept))


def _numbered(table: pa.Table, own: np.ndarray) -> Rows:
    """What the ``words`` of ``table`` have of ``own``, as places in it; a thousand texts are looked up at a time."""
    rows, places, first = [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int32)], 0
    for batch in table.to_batches(max_chunksize=SAMPLE_BATCH) if len(own) else []:
        lists = batch["words"]
        word, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
        place = np.minimum(np.searchsorted(own, word), len(own) - 1).astype(np.int32)
        known = own[place] == word
        rows.append(np.repeat(np.arange(first, first + len(sizes), dtype=np.int32), sizes)[known])
        places.append(place[known])
        first += len(sizes)
    return Rows(np.concatenate(rows), np.concatenate(places), len(table))


FITTED = "left_out int, words array<int>, weights array<double>, earlier array<double>, intercept double, held array<long>, told array<double>"


def _fit_models(rows: DataFrame, category: str, earlier: list[tuple[np.ndarray, np.ndarray]], chosen: dict[int, np.ndarray], options: dict) -> list:
    """One model for each fold left out (-1: none), each in a task: its parameters, and probabilities of the fold's rows.

    ``rows`` has (row, fold, <category>, words), words as places in the vocabulary, and so has ``chosen``; ``earlier`` sorted rows and probabilities of each category before.
    """

    def fitted(table: pa.Table) -> pa.Table:
        left_out = table["left_out"][0].as_py()
        ids, fold = table["row"].to_numpy(), table["fold"].to_numpy()
        label = table[category].to_numpy()
        own = chosen.get(left_out, np.zeros(0, dtype=np.int32))
        every = _numbered(table.select(["words"]), own)
        before = np.column_stack([p[np.searchsorted(i, ids)] for i, p in earlier]) if earlier else np.zeros((len(ids), 0))
        train, held = ~np.isnan(label) & (fold != left_out), fold == left_out
        asked = every.take(held)
        every = every.take(train)
        model = fit(every, label[train], before[train], **options)
        told = probability(model, asked, before[held])
        one = lambda x, kind: pa.array([x], pa.list_(kind))
        return pa.Table.from_arrays(
            [pa.array([left_out], pa.int32()), one(own[model.words], pa.int32()), one(model.weights, pa.float64()), one(model.earlier, pa.float64()), pa.array([model.intercept]), one(ids[held], pa.int64()), one(told, pa.float64())],
            names=[c.split()[0] for c in FITTED.split(", ")],
        )

    dealt = rows.select("row", "fold", category, "words", F.explode(F.array(*[F.lit(k) for k in chosen])).alias("left_out"))
    return dealt.groupBy("left_out").applyInArrow(fitted, FITTED).collect()  # parameters, and sample_rows probabilities in all


def word_rows(column: pa.Array, vocabulary: np.ndarray | None = None) -> Iterator[tuple[int, int, Rows]]:
    """Runs of texts with the different words of each, and the beginnings of its words; only known ones if told."""
    for lo, hi, offsets, data in textscan.chunks(column, TEXT_BYTES):
        data = textscan.LOWER[data]
        starts, ends, row = textscan.words(offsets, data, textscan.LEXICAL)
        rows, words = [row], [textscan.span_hashes(data, starts, ends)]
        for size in PREFIX_BYTES:
            longer = ends - starts > size
            rows.append(row[longer])
            words.append(textscan.mix(textscan.span_hashes(data, starts[longer], starts[longer] + size) + np.uint64(size)))
        row, word = np.concatenate(rows), np.concatenate(words)
        if vocabulary is not None:
            known = vocabulary[np.minimum(np.searchsorted(vocabulary, word), len(vocabulary) - 1)] == word if len(vocabulary) else np.zeros(len(word), dtype=bool)
            row, word = row[known], word[known]
        order = np.lexsort((word, row))
        row, word = row[order], word[order]
        keep = np.append(True, (row[1:] != row[:-1]) | (word[1:] != word[:-1])) if len(row) else np.zeros(0, dtype=bool)
        yield lo, hi, Rows(row[keep], word[keep], hi - lo)


def _batches_of_words(batch: pa.RecordBatch, names: list[str], vocabulary: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    for lo, hi, rows in word_rows(batch["text"], vocabulary):
        bounds = np.searchsorted(rows.row, np.arange(hi - lo + 1))
        # of a vocabulary, places take half the memory of hashes wherever they go
        entries = rows.word.view(np.int64) if vocabulary is None else np.searchsorted(vocabulary, rows.word).astype(np.int32)
        words = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(entries))
        yield pa.RecordBatch.from_arrays([batch[c].slice(lo, hi - lo) for c in names] + [words], names=[*names, "words"])


def train(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], *, sample_rows: int = SAMPLE_ROWS, max_features: int = MAX_FEATURES, least: int = LEAST_DOCUMENTS, **options) -> list[Linear] | None:
    """Fit the chain on a bounded sample of ``labels(doc_id, <categories>)``.

    Spark counts in how many documents of each label and fold each word is and chooses the telling ones;
    what the documents have of these goes to the tasks that fit.
    """
    order = F.xxhash64(F.lit(1), "doc_id")
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("double").alias(c) for c in categories]).where("doc_id is not null").orderBy(order, *categories).limit(sample_rows)
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # sample_rows at most
    # a text counts once; of copies the smallest id speaks
    first = F.min(F.struct("doc_id", *categories)).alias("row")
    sample = sample.groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(first).select("text", "row.*")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fold = F.pmod(F.xxhash64(F.lit(2), "doc_id"), F.lit(FOLDS)).cast("int")
    sample = sample.repartition(parts, "doc_id").withColumn("fold", fold).withColumn("row", F.monotonically_increasing_id())
    sample = saved(sample, "labelled")  # a small table, but much to count in it
    names = ["row", "fold", *categories]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(word, cell, n): documents by word, and by category, fold and label as one number."""
        for whole in batches:
            for batch in _batches_of_words(whole, names):
                lists = batch["words"]
                word, sizes = lists.values.to_numpy(), np.diff(lists.offsets.to_numpy())
                fold = batch["fold"].to_numpy().astype(np.int64)
                for k, c in enumerate(categories):
                    label = batch[c].to_numpy(zero_copy_only=False)
                    cell = np.repeat((k * FOLDS + fold) * 2 + (label > 0), sizes)
                    known = np.repeat(~np.isnan(label), sizes)
                    pair = np.stack([word[known], cell[known]])
                    pair = pair[:, np.lexsort(pair[::-1])]
                    head = np.flatnonzero(np.append(True, (pair[:, 1:] != pair[:, :-1]).any(axis=0))) if pair.shape[1] else np.zeros(0, dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(pair[0, head]), pa.array(pair[1, head]), pa.array(np.diff(np.append(head, pair.shape[1])))], names=["word", "cell", "n"])

    cells = len(categories) * FOLDS * 2
    counted = sample.mapInArrow(count, "word long, cell long, n long").groupBy("word").agg(*[F.sum(F.when(F.col("cell") == k, F.col("n")).otherwise(0)).cast("int").alias(f"c{k}") for k in range(cells)])
    # what one category counts of a word, all of them bound: a document has a word once
    often = [sum(F.col(f"c{j}") for j in range(k * FOLDS * 2, (k + 1) * FOLDS * 2)) >= least for k in range(len(categories))]
    counts = saved(counted.where(reduce(lambda a, b: a | b, often)), "word-counts")
    known = lambda c: [F.count(c).alias(f"n_{c}"), F.coalesce(F.sum(F.when(F.col(c) > 0, 1).otherwise(0)), F.lit(0)).alias(f"p_{c}")]
    people = {r["fold"]: r for r in sample.groupBy("fold").agg(*[x for c in categories for x in known(c)]).collect()}  # FOLDS rows
    if not people:
        return None
    models_of = [(k, left_out) for k in range(len(categories)) for left_out in range(-1, FOLDS if k + 1 < len(categories) else 0)]

    def seen(k: int, left_out: int) -> tuple[Column, Column]:
        inside = [f for f in range(FOLDS) if f != left_out]
        positive = reduce(lambda x, y: x + y, [F.col(f"c{(k * FOLDS + f) * 2 + 1}") for f in inside])
        return positive, positive + reduce(lambda x, y: x + y, [F.col(f"c{(k * FOLDS + f) * 2}") for f in inside])

    tried = counts.agg(*[F.count(F.when(seen(*m)[1] >= least, 1)).alias(f"t{i}") for i, m in enumerate(models_of)]).first()
    telling: dict[tuple[int, int], np.ndarray] = {}
    for i, (k, left_out) in enumerate(models_of):
        inside = [r for f, r in people.items() if f != left_out]
        n, n_positive = (sum(r[f"{x}_{categories[k]}"] for r in inside) for x in "np")
        telling[k, left_out] = np.zeros(0, dtype=np.int64)
        if 0 < n_positive < n:
            positive, total = seen(k, left_out)
            found = _telling(counts, positive, total, n, n_positive, tried[f"t{i}"], max_features, least).collect()  # max_features at most
            telling[k, left_out] = np.sort(np.array([r["word"] for r in found], dtype=np.int64))
    vocabulary = np.unique(np.concatenate(list(telling.values())).view(np.uint64))
    places = {m: np.sort(np.searchsorted(vocabulary, words.view(np.uint64))).astype(np.int32) for m, words in telling.items()}

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _batches_of_words(batch, names, vocabulary)

    shape = f"row long, fold int, {', '.join(f'{c} double' for c in categories)}, words array<int>"
    rows = saved(sample.mapInArrow(told, shape), "labelled-words")
    chain, earlier = [], []
    for k, category in enumerate(categories):
        models = _fit_models(rows, category, earlier, {m: places[k, m] for j, m in models_of if j == k}, options)
        whole = next(m for m in models if m["left_out"] == -1)
        words = vocabulary[np.array(whole["words"], dtype=np.int64)]  # sorted, as places are
        chain.append(Linear(words, np.array(whole["weights"]), np.array(whole["earlier"]), whole["intercept"]))
        if k + 1 < len(categories):
            ids = np.concatenate([np.array(m["held"], dtype=np.int64) for m in models])
            share = np.concatenate([np.array(m["told"], dtype=float) for m in models])
            earlier.append((np.sort(ids), share[np.argsort(ids)]))
    return chain


def score(docs: DataFrame, models: list[Linear] | None, categories: tuple[str, ...]) -> DataFrame:
    """(doc_id, p_<category> ...) for each row of ``docs(doc_id, text)``."""
    sent = docs.sparkSession.sparkContext.broadcast(models)  # max_features words for each category

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = sent.value
        vocabulary = np.unique(np.concatenate([m.words for m in chain])) if chain else np.zeros(0, dtype=np.uint64)
        for batch in batches:
            for lo, hi, rows in word_rows(batch["text"], vocabulary):
                told = np.zeros((hi - lo, 0))
                for k in range(len(categories)):
                    told = np.column_stack([told, probability(chain[k], rows, told) if chain else np.zeros(hi - lo)])
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(lo, hi - lo), *(pa.array(told[:, k]) for k in range(len(categories)))], names=["doc_id", *(f"p_{c}" for c in categories)])

    shape = f"doc_id long, {', '.join(f'p_{c} double' for c in categories)}"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(predict, shape)


def toxicity(docs: DataFrame, labels: DataFrame, *, categories: tuple[str, ...] = CATEGORIES, threshold: float = THRESHOLD, **options) -> DataFrame:
    """Probabilities of all categories, and whether the last one is at or above the threshold."""
    scored = score(docs, train(docs, labels, categories, **options), categories)
    return scored.withColumn(categories[-1], F.col(f"p_{categories[-1]}") >= threshold)


def reject_toxic(docs: DataFrame, labels_for: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not toxic; the chain is fitted on ``labels_for`` with ``labels``."""
    # whole rows travel in one column, so no name of theirs can clash
    keyed = docs.select(F.struct("*").alias("doc"), F.xxhash64("doc_id", "text").alias("row"), "text")
    models = train(labels_for, labels, CATEGORIES, **options)
    scored = score(keyed.select(F.col("row").alias("doc_id"), "text"), models, CATEGORIES)
    bad = scored.where(F.col(f"p_{CATEGORIES[-1]}") >= THRESHOLD).select(F.col("doc_id").alias("row")).distinct()
    return keyed.join(bad, "row", "left_anti").select("doc.*")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
