"""Packing token sequences by minimum bin slack.

How many pieces there are of each length is all that the packing decision needs, and lengths end at the
capacity, so the decision works on a histogram of at most ``capacity`` rows however many documents
there are. For each bin, the longest remaining piece is taken and a subset-sum dynamic programme over
the remaining lengths, held as bits of an integer, finds the fullest completion. That combination is
removed as often as the histogram allows before the next one is sought, so the number of searches is
bounded by the capacity and not by the data.

Spark then carries the decision out: pieces are numbered within their length (counts by task and
length, then a running sum over tasks), and each number falls in one interval of one combination.

Defined results: a null text counts as empty and gives a piece of one id, the separator; a text of
more ids than the capacity is cut so that only its first piece may be shorter; rows that share a
``doc_id`` are packed separately; an empty table gives no sequence; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm import tokens
from skein.llm.storage import saved

CAPACITY = 2048
SEPARATOR_ID = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def fullest(lengths: list[int], counts: list[int], room: int) -> list[tuple[int, int]]:
    """The (length, copies) whose sum is the largest that fits in ``room``; long pieces come first.

    ``lengths`` are descending. Bit s of a state is set when some choice among the lengths so far sums
    to s; the states are kept to walk back through the choices.
    """
    full = (1 << (room + 1)) - 1
    state, states, used = 1, [], []
    for length, count in zip(lengths, counts, strict=True):
        if length > room:
            continue
        before, left, step = state, min(count, room // length), 1
        while left:
            take = min(step, left)
            state |= (state << (take * length)) & full
            left -= take
            step *= 2
        states.append(before)
        used.append((length, count))
        if state >> room & 1:
            break
    target, chosen = state.bit_length() - 1, []
    for (length, count), before in zip(reversed(used), reversed(states), strict=True):
        copies = 0
        while not before >> target & 1:
            target -= length
            copies += 1
        if copies:
            chosen.append((length, copies))
    return chosen


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Combinations as (how many bins, [(length, copies in each bin)]), covering the histogram exactly."""
    left, plan = {k: v for k, v in histogram.items() if v}, []
    order = sorted(left, reverse=True)
    while order:
        top = order[0]
        left[top] -= 1
        rest = [k for k in order if left[k]]
        combination = {top: 1}
        for length, copies in fullest(rest, [left[k] for k in rest], capacity - top):
            combination[length] = combination.get(length, 0) + copies
        left[top] += 1
        bins = min(left[k] // n for k, n in combination.items())
        for k, n in combination.items():
            left[k] -= bins * n
        plan.append((bins, sorted(combination.items(), reverse=True)))
        order = [k for k in order if left[k]]
    return plan


def cut_pieces(docs: DataFrame, *, capacity: int = CAPACITY, separator_id: int = SEPARATOR_ID, vocabulary: str | None = None) -> DataFrame:
    """Tokenise ``docs(doc_id, text)`` and cut what is too long; ``nth`` counts a task's pieces of a length."""
    vocabulary = vocabulary or tokens.vocabulary_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = tokens.encoder(vocabulary), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            task = batch["task"][0].as_py() if batch.num_rows else 0
            for lo, hi, ids, ends in encoder.encode(batch["text"]):
                doc_ids = batch["doc_id"].slice(lo, hi - lo)
                sizes = np.diff(ends) + 1
                ids = np.insert(ids, ends[1:], separator_id)
                data = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
                pieces = -(-sizes // capacity)
                row = np.repeat(np.arange(hi - lo), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first = (sizes - 1) % capacity + 1
                start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, first[row], capacity)
                begin = np.append(0, np.cumsum(sizes))[:-1][row] + start
                crc = [zlib.crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(begin.tolist(), length.tolist(), strict=True)]
                by_length = np.argsort(length, kind="stable")
                runs = length[by_length]
                heads = np.flatnonzero(np.diff(runs, prepend=-1))
                nth = np.empty(len(row), dtype=np.int64)
                nth[by_length] = np.arange(len(row)) - np.repeat(heads, np.diff(np.append(heads, len(row)))) + seen[runs]
                np.add.at(seen, length, 1)
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(row), task), pa.int32()), pa.array(nth)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"],
                )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.spark_partition_id().alias("task"))
    return texts.mapInArrow(cut, PIECES)


def pack(docs: DataFrame, *, capacity: int = CAPACITY, separator_id: int = SEPARATOR_ID, vocabulary: str | None = None) -> DataFrame:
    """One row for each piece: where it comes from, and its sequence and place there."""
    spark = docs.sparkSession
    # numbers within a task are only stable once they are written
    pieces = saved(cut_pieces(docs, capacity=capacity, separator_id=separator_id, vocabulary=vocabulary), "pieces")
    counts = saved(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "piece-counts")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # at most one row for each length up to the capacity
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}

    keys, firsts, copies, offsets = [], [], [], []
    used: dict[int, int] = {}
    sequence = 0
    for bins, combination in plan_bins(histogram, capacity):
        offset = 0
        for length, n in combination:
            keys.append((length, used.get(length, 0)))
            firsts.append(sequence)
            copies.append(n)
            offsets.append(offset)
            used[length] = used.get(length, 0) + bins * n
            offset += length * n
        sequence += bins
    intervals = spark.sparkContext.broadcast(sorted(zip(keys, firsts, copies, offsets, strict=True)))  # bounded by the capacity, not by the data

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = intervals.value
        of = np.array([k[0] for k, *_ in table], dtype=np.int64)
        lowest = np.array([k[1] for k, *_ in table], dtype=np.int64)
        first, many, at = (np.array([x[i] for x in table], dtype=np.int64) for i in (1, 2, 3))
        span = int(lowest.max(initial=0)) + 1
        code = of * span + lowest
        for batch in batches:
            length, nth = batch["length"].to_numpy(), batch["number"].to_numpy()
            k = np.searchsorted(code, length * span + np.minimum(nth, span - 1), side="right") - 1
            bin_, slot = np.divmod(nth - lowest[k], many[k])
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(first[k] + bin_), pa.array(at[k] + slot * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    numbered = pieces.join(bases, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("number"))
    return numbered.mapInArrow(place, PACKED)


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
