"""Repeated byte strings across documents, by suffix arrays built with two-stage sorting.

A byte is removed if a string of ``width`` bytes around it also starts in a document with a smaller
id. Suffixes of all texts at once cannot be sorted in one place, so equal strings are brought together
first, and only those that can be equal:

1. Texts are packed into blocks of some megabytes, compressed, one row each.
2. Minimisers: in any ``width`` bytes the gram with the smallest hash stands out, and equal strings
   have equal ones. Blocks of documents send each different minimiser once; those that two blocks
   send, or two documents of one block have, come back as shared. The rest of the text is done with.
3. Segments: the stretch of text whose strings have a given shared minimiser. Equal segments are
   one row with the smallest document id; a segment goes where its minimiser's hash says.
4. Suffix array: a task sorts the suffixes of its segments in two stages. Only suffixes smaller than
   their successor are sorted directly, by words of eight bytes; all others are induced by scanning the
   buckets of first bytes in ascending order. A task sorts ``SORT_BYTES`` at a time. Adjacent common prefixes of at least ``width`` bytes join
   equal strings, and the smallest document id among them decides.
5. The verdicts go back to the segments' documents, which cut their text.

Defined results: a null text counts as empty; texts shorter than ``width`` keep everything; matches
never cross documents; rows that share a ``doc_id`` do not count as smaller than one another; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import textscan
from skein.llm.storage import saved

WIDTH = 50
GRAM = 20
#: Text in a block, and in what a task gets to compare; hash ranges follow from the number of blocks.
BLOCK_BYTES = 4 << 20
PIECE_BYTES = 1 << 19
LEAST_BUCKETS, MOST_BUCKETS = 64, 1 << 24
#: Text that is sorted at once; a bucket's minimisers are dealt to as many sorts as that takes.
SORT_BYTES = 1 << 20
_WORDS = 8  # words of eight bytes that a direct sort looks at


def two_stage_suffix_array(text: np.ndarray, depth_words: int = _WORDS) -> np.ndarray:
    """Suffixes of ``text`` (bytes) in order of at least their first ``8 * depth_words`` bytes.

    A suffix is of the small type if it is smaller than its successor; those are sorted directly. Any
    other suffix starts with a byte no smaller than its successor's, so a scan in ascending order meets
    the successor first and can append the suffix to its bucket.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    # type of i: text[i] < text[j] at the next place j with another byte; the end is smaller than all
    change = np.flatnonzero(text[1:] != text[:-1])
    rises = np.append(text[change + 1] > text[change], False)
    small = np.repeat(rises, np.diff(np.concatenate([[-1], change, [n - 1]])))
    word = _words(text, n + 8 * depth_words)
    # direct sort: by the first word, then tied groups by the next one
    order = np.flatnonzero(small)
    order = order[np.argsort(word[order], kind="stable")]
    keys = word[order]
    tied = np.zeros(len(order), dtype=bool)
    if len(order):
        same = keys[1:] == keys[:-1]
        tied[1:] |= same
        tied[:-1] |= same
    group = np.cumsum(np.append(True, ~same)) if len(order) else np.zeros(0, dtype=np.int64)
    for depth in range(1, depth_words):
        where = np.flatnonzero(tied)
        if not len(where):
            break
        part, g = order[where], group[where]
        w = word[part + 8 * depth]
        inner = np.lexsort((w, g))
        part, g, w = part[inner], g[inner], w[inner]
        order[where] = part
        same = (g[1:] == g[:-1]) & (w[1:] == w[:-1])
        still = np.zeros(len(where), dtype=bool)
        still[1:] |= same
        still[:-1] |= same
        fresh = np.cumsum(np.append(True, ~same))
        group[where] = fresh
        tied[where] = still
    edges = np.searchsorted(text[order], np.arange(257))
    # induced: predecessors with a larger byte wait in their bucket, in scan order
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[n - 1]].append(np.array([n - 1], dtype=np.int64))
    out = []
    for byte in range(256):
        level = np.concatenate(waiting[byte]) if waiting[byte] else np.zeros(0, dtype=np.int64)
        bucket = []
        while len(level):
            bucket.append(level)
            before = level[level > 0] - 1
            level = before[text[before] == byte]
        bucket.append(order[edges[byte] : edges[byte + 1]])
        bucket = np.concatenate(bucket)
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        first = text[before]
        before, first = before[first > byte], first[first > byte]
        if len(before):
            by_byte = np.argsort(first, kind="stable")
            before, first = before[by_byte], first[by_byte]
            heads = np.flatnonzero(np.diff(first.astype(np.int16), prepend=-1))
            for head, group_ in zip(first[heads], np.split(before, heads[1:]), strict=True):
                waiting[head].append(group_)
    return np.concatenate(out)


def _words(text: np.ndarray, n: int) -> np.ndarray:
    """The eight bytes from each of the first ``n`` places, as numbers in byte order; zeros follow the text."""
    padded = np.zeros(n + 8, dtype=np.uint8)
    padded[: len(text)] = text
    word = np.zeros(n, dtype=np.uint64)
    for k in range(8):
        word |= padded[k : k + n].astype(np.uint64) << np.uint64(56 - 8 * k)
    return word


def common_prefixes(text: np.ndarray, order: np.ndarray, width: int) -> np.ndarray:
    """For each suffix in order but the first: does it share ``width`` bytes with the one before it?"""
    words, rest = divmod(width, 8)
    word = _words(text, len(text) + width)
    a, b = order[:-1], order[1:]
    same = np.ones(len(a), dtype=bool)
    for k in [8 * i for i in range(words)] + ([width - 8] if rest else []):
        live = np.flatnonzero(same)
        same[live] = word[a[live] + k] == word[b[live] + k]
    return same


def minimizers(data: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of texts that stand end to end: (row, first string, string after the last, minimiser hash).

    A string is told by its first byte; a segment holds the consecutive strings with the same gram.
    """
    starts = len(data) - width + 1
    none = np.zeros(0, dtype=np.int64)
    if starts <= 0:
        return none, none, none, none.astype(np.uint64)
    hashes = textscan.window_hashes(data, gram)
    # smallest over the grams of each string, by doubling; ties go to the leftmost
    grams = width - gram + 1
    least, span = hashes, 1
    while span * 2 <= grams:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    if span < grams:
        least = np.minimum(least[: len(least) - (grams - span)], least[grams - span :])
    least = least[:starts]
    valid = np.zeros(starts + 1, dtype=np.int32)
    begin = offsets[:-1]
    end = np.maximum(begin, offsets[1:] - width + 1)
    real = end > begin
    np.add.at(valid, begin[real], 1)
    np.add.at(valid, end[real], -1)
    inside = np.cumsum(valid[:-1]) > 0
    heads = inside.copy()
    heads[1:] &= ~inside[:-1] | (least[1:] != least[:-1])
    heads[begin[real]] = True
    first = np.flatnonzero(heads)
    tails = inside.copy()
    tails[:-1] &= heads[1:] | ~inside[1:]
    last = np.flatnonzero(tails) + 1
    return np.searchsorted(offsets, first, side="right") - 1, first, last, least[first]


def _judged(sent: pa.Array, low: np.ndarray, high: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Runs (segment, from string, strings, smallest document) of ``sent`` segments, where they can matter to one of its documents."""
    different = sent.dictionary_encode()
    which, segments = different.indices.to_numpy(), different.dictionary
    owner = np.full(len(segments), np.iinfo(np.int64).max)
    np.minimum.at(owner, which, low)
    bounds, text = textscan.string_buffers(segments.cast(pa.large_binary()).view(pa.large_string()))
    order = two_stage_suffix_array(text, max(_WORDS, -(-width // 8)))
    group = np.cumsum(np.append(True, ~common_prefixes(text, order, width)))
    of = np.repeat(np.arange(len(segments)), np.diff(bounds))
    whole = order + width <= bounds[1:][of[order]]  # the string lies within its segment
    order, group = order[whole], group[whole]
    heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    least = np.minimum.reduceat(owner[of[order]], heads)
    verdict, known = np.zeros(len(text), dtype=np.int64), np.zeros(len(text), dtype=bool)
    verdict[order], known[order] = np.repeat(least, np.diff(np.append(heads, len(order)))), True
    starts = known.copy()
    starts[1:] &= (verdict[1:] != verdict[:-1]) | ~known[:-1] | (of[1:] != of[:-1])
    begin = np.flatnonzero(starts)
    tails = known.copy()
    tails[:-1] &= starts[1:] | ~known[1:]
    length = np.flatnonzero(tails) + 1 - begin
    owned, value = of[begin], verdict[begin]
    edges = np.searchsorted(owned, np.arange(len(segments) + 1))
    counts = np.diff(edges)[which]
    run = np.arange(counts.sum()) + np.repeat(edges[:-1][which] - (np.cumsum(counts) - counts), counts)
    segment = np.repeat(np.arange(len(which)), counts)
    matters = value[run] < high[segment]
    run, segment = run[matters], segment[matters]
    return segment, begin[run] - bounds[owned[run]], length[run], value[run]


BLOCKS = "block long, ids binary, offsets binary, packed binary"


def pack_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of some megabytes of compressed texts with their document ids and byte offsets."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.spark_partition_id().cast("long").alias("task"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, ids, sizes, parts, held = 0, [], [], [], 0

        def row() -> pa.RecordBatch:
            blob = zlib.compress(b"".join(parts), 1)
            own = np.concatenate(ids).astype("<i8")
            ends = np.append(0, np.cumsum(np.concatenate(sizes))).astype("<i8")
            return pa.RecordBatch.from_pydict({"block": pa.array([(task << 32) + k], pa.int64()), "ids": pa.array([own.tobytes()], pa.binary()), "offsets": pa.array([ends.tobytes()], pa.binary()), "packed": pa.array([blob], pa.binary())})

        for batch in batches:
            if not batch.num_rows:
                continue
            task = batch["task"][0].as_py()
            numbers = batch["doc_id"].fill_null(NULL_ID).to_numpy()
            for lo, hi, offsets, data in textscan.chunks(batch["text"], block_bytes):
                if held and held + len(data) > block_bytes:
                    yield row()
                    k, ids, sizes, parts, held = k + 1, [], [], [], 0
                ids.append(numbers[lo:hi])
                sizes.append(np.diff(offsets))
                parts.append(data.tobytes())
                held += len(data)
        if ids:
            yield row()

    return texts.mapInArrow(packed, BLOCKS)


#: Stands for a null id inside blocks; it is smaller than every other.
NULL_ID = -(1 << 63)


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, offsets = np.frombuffer(row["ids"], dtype="<i8"), np.frombuffer(row["offsets"], dtype="<i8")
    return ids, offsets, np.frombuffer(zlib.decompress(row["packed"]), dtype=np.uint8)


def _segments(offsets: np.ndarray, data: np.ndarray, width: int, gram: int) -> Iterator[tuple]:
    """Segments of a block's texts (rows, first and last strings, minimisers), a piece at a time."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + PIECE_BYTES, side="right")) - 1)
        a, b = int(offsets[lo]), int(offsets[hi])
        row, first, last, least = minimizers(data[a:b], offsets[lo : hi + 1] - a, width, gram)
        yield row + lo, first + a, last + a, least
        lo = hi


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {c: batch[c][k].as_py() for c in batch.schema.names}


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table[name]
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def repeated_spans(docs: DataFrame, *, width: int = WIDTH, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks with the spans to remove: (ids, offsets, packed, spans); see ``remove_repeats``.

    ``spans`` holds (row in block, from byte, to byte) as 64-bit integers, in ascending order, merged.
    """
    if width < gram:
        raise ValueError(f"a width of {width} bytes is smaller than the gram of {gram}")
    blocks = saved(pack_blocks(docs, block_bytes), "blocks")
    buckets = int(min(MOST_BUCKETS, max(LEAST_BUCKETS, 4 * blocks.count())))
    step = np.uint64((1 << 64) // buckets)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each different minimiser of a block once; ``twice`` where two of its documents have it."""
        for item in _rows(batches):
            _, offsets, data = _unpacked(item)
            found = list(_segments(offsets, data, width, gram))
            h = np.concatenate([x[3] for x in found])
            if not len(h):
                continue
            order = np.argsort(h)
            h, o = h[order], np.concatenate([x[0] for x in found])[order]
            heads = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            twice = np.maximum.reduceat(o, heads) != np.minimum.reduceat(o, heads)
            h = h[heads]
            bucket = bucket_of(h)
            cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            ends = [*cuts[1:].tolist(), len(h)]
            low = h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_PRINT_BYTES]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket[cuts].astype(np.int32)),
                    pa.array(np.full(len(cuts), item["block"])),
                    pa.array([low[a:b].tobytes() for a, b in zip(cuts.tolist(), ends, strict=True)], pa.binary()),
                    pa.array([np.packbits(twice[a:b]).tobytes() for a, b in zip(cuts.tolist(), ends, strict=True)], pa.binary()),
                ],
                names=["bucket", "block", "prints", "twice"],
            )

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Send back to each block those of its minimisers that another document also has."""
        senders, prints, twice, bucket = [], [], [], 0
        for item in _rows(batches):
            bucket = item["bucket"]
            senders.append(item["block"])
            prints.append(_prints(item["prints"]))
            twice.append(np.unpackbits(np.frombuffer(item["twice"], dtype=np.uint8), count=len(prints[-1])).astype(bool))
        every = np.concatenate(prints)
        ordered = np.sort(every)
        common = np.union1d(ordered[1:][ordered[1:] == ordered[:-1]], every[np.concatenate(twice)])
        out = []
        for block, own in zip(senders, prints, strict=True):
            kept = own[_member(common, own)]
            if len(kept):
                out.append((block, kept.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_PRINT_BYTES].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([bucket] * len(out), pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["block", "bucket", "prints"])

    def bucket_of(hashes: np.ndarray) -> np.ndarray:
        return np.minimum(hashes // step, np.uint64(buckets - 1)).astype(np.int64)

    sent = blocks.mapInArrow(send, "bucket int, block long, prints binary, twice binary")
    answers = saved(sent.groupBy("bucket").applyInArrow(share, "block long, bucket int, prints binary"), "shared-minimisers")
    # copies of one text: all strings of all but the first are repeats, and the first stands for them
    texts = blocks.mapInArrow(_digests, "block long, row int, doc_id long, digest binary")
    firsts = saved(texts.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1"), "text-classes")
    repeats = texts.join(firsts, "digest").where("doc_id > first_id").groupBy("block").agg(F.collect_list("row").alias("repeats"))
    # no more in a block's answer than the block has sent
    answered = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "prints")).alias("answer"))
    told = saved(answered.join(repeats, "block", "full").select("block", "answer", "repeats"), "answers")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each different segment of a block that has a shared minimiser, with its first and last document."""
        for item in _rows(batches):
            ids, offsets, data = _unpacked(item)
            own = _own_rows(item, len(ids))
            common = np.sort(np.concatenate([_prints(x["prints"]) | np.uint64(x["bucket"]) << np.uint64(8 * _PRINT_BYTES) for x in item["answer"] or ()] or [np.zeros(0, dtype=np.uint64)]))
            for row, first, last, least in _segments(offsets, data, width, gram):
                bucket = bucket_of(least)
                keep = own[row] & _member(common, least & _PRINT_MASK | bucket.astype(np.uint64) << np.uint64(8 * _PRINT_BYTES))
                row, first, end, bucket = row[keep], first[keep], last[keep] + width - 1, bucket[keep]
                part = (least[keep] & np.uint64(0xFF)).astype(np.int64)
                if not len(row):
                    continue
                base = int(first[0])
                key = textscan.span_hashes(data[base : end.max()], first - base, end - base)
                order = np.lexsort((key, bucket))
                key, bucket, row, first, end, part = key[order], bucket[order], row[order], first[order], end[order], part[order]
                heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                doc = ids[row]
                low, high = np.minimum.reduceat(doc, heads), np.maximum.reduceat(doc, heads)
                key, bucket, first, end, part = key[heads], bucket[heads], first[heads], end[heads], part[heads]
                raw = data.tobytes()
                cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist()
                out = []
                for a, b in zip(cuts, [*cuts[1:], len(key)], strict=True):
                    pieces = b"".join([raw[x:y] for x, y in zip(first[a:b].tolist(), end[a:b].tolist(), strict=True)])
                    out.append((int(bucket[a]), item["block"], zlib.compress(pieces, 1), zlib.compress(_packed(end[a:b] - first[a:b], low[a:b], high[a:b], key[a:b].view(np.int64), part[a:b]), 1)))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary()), pa.array([x[3] for x in out], pa.binary())], names=["bucket", "block", "text", "about"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each segment sent: the smallest document of each of its strings, as runs of strings."""
        items = list(_rows(batches))
        about = [_fields(zlib.decompress(x["about"]), 5) for x in items]
        size, low, high, key, part = (np.concatenate([x[k] for x in about]) for k in range(5))
        of_item = np.repeat(np.arange(len(items)), [len(x[0]) for x in about])
        ends = np.cumsum(size)
        every = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.append(0, ends)), pa.py_buffer(b"".join([zlib.decompress(x["text"]) for x in items]))])
        # equal strings have the same minimiser and so the same part
        by_part = np.argsort(part, kind="stable")
        heads = np.flatnonzero(np.append(True, np.diff(part[by_part]) > 0))
        cuts = [0]
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(by_part)], strict=True):
            if a > cuts[-1] and int(size[by_part[cuts[-1] : b]].sum()) > SORT_BYTES:
                cuts.append(a)
        found = []
        for a, b in zip(cuts, [*cuts[1:], len(by_part)], strict=True):
            own = by_part[a:b]
            segment, at, length, value = _judged(every.take(pa.array(own)), low[own], high[own], width)
            found.append((own[segment], at, length, value))
        segment, at, length, value = (np.concatenate([x[k] for x in found]) for k in range(4))
        item = of_item[segment]
        order = np.argsort(item, kind="stable")
        segment, at, length, value = segment[order], at[order], length[order], value[order]
        bounds = np.searchsorted(item[order], np.arange(len(items) + 1)).tolist()
        out = [(items[k]["block"], zlib.compress(_packed(key[segment[a:b]], at[a:b], length[a:b], value[a:b]), 1)) for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], names=["block", "runs"])

    joined = blocks.join(told, "block", "left")
    judged = joined.mapInArrow(cut, "bucket int, block long, text binary, about binary").groupBy("bucket").applyInArrow(judge, "block long, runs binary")

    def spans(left: pa.Table, right: pa.Table) -> pa.Table:
        runs = [_fields(zlib.decompress(x.as_py()), 4) for x in right["runs"]]
        key, at, length, least = (np.concatenate([x[k] for x in runs] or [np.zeros(0, dtype=np.int64)]) for k in range(4))
        order = np.argsort(key.view(np.uint64), kind="stable")
        key, at, length, least = key.view(np.uint64)[order], at[order], length[order], least[order]
        done = []
        for item in _rows(left.to_batches()):
            ids, offsets, data = _unpacked(item)
            own = _own_rows(item, len(ids))
            sizes = np.diff(offsets)
            copies = np.flatnonzero(~own & (sizes >= width))
            row_of, begins, ends = [copies], [offsets[copies]], [offsets[copies + 1]]
            for row, first, last, _ in _segments(offsets, data, width, gram) if len(key) else ():
                if not len(row):
                    continue
                base, end = int(first[0]), last + width - 1
                mine = textscan.span_hashes(data[base : end.max()], first - base, end - base)
                lo, hi = np.searchsorted(key, mine, side="left"), np.searchsorted(key, mine, side="right")
                counts = (hi - lo) * own[row]
                run = np.arange(counts.sum()) + np.repeat(lo - (np.cumsum(counts) - counts), counts)
                segment = np.repeat(np.arange(len(row)), counts)
                matters = least[run] < ids[row[segment]]
                run, segment = run[matters], segment[matters]
                start = first[segment] + at[run]
                row_of.append(row[segment])
                begins.append(start)
                ends.append(start + length[run] + width - 1)
            done.append((item["ids"], item["offsets"], item["packed"], _merged(np.concatenate(row_of), np.concatenate(begins), np.concatenate(ends)).astype("<i8").tobytes()))
        return pa.Table.from_arrays([pa.array([x[k] for x in done], pa.binary()) for k in range(4)], names=["ids", "offsets", "packed", "spans"])

    # the same shuffle of blocks serves the segments and this step
    together = joined.groupBy("block").cogroup(judged.groupBy("block"))
    return together.applyInArrow(spans, "ids binary, offsets binary, packed binary, spans binary")


#: Bytes of a minimiser's hash that travel, besides its bucket; a chance match only sends a segment in vain.
_PRINT_BYTES = 5
_PRINT_MASK = np.uint64((1 << 8 * _PRINT_BYTES) - 1)


def _prints(packed: bytes) -> np.ndarray:
    low = np.frombuffer(packed, dtype=np.uint8).reshape(-1, _PRINT_BYTES)
    wide = np.zeros((len(low), 8), dtype=np.uint8)
    wide[:, :_PRINT_BYTES] = low
    return wide.view("<u8").ravel().astype(np.uint64)


def _member(ordered: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), dtype=bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _packed(*columns: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(c, dtype="<i8").tobytes() for c in columns)


def _fields(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(packed, dtype="<i8").reshape(n, -1)


def _own_rows(item: dict, n: int) -> np.ndarray:
    """Which rows of a block are the first document with their text."""
    own = np.ones(n, dtype=bool)
    own[item["repeats"] or []] = False
    return own


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for item in _rows(batches):
        ids, offsets, data = _unpacked(item)
        raw, ends = data.tobytes(), offsets.tolist()
        found = [hashlib.sha256(raw[a:b]).digest()[:16] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), item["block"])), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids), pa.array(found, pa.binary())], names=["block", "row", "doc_id", "digest"])


def _merged(rows: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows (row, begin, end) with what overlaps or touches within a row made one."""
    if not len(rows):
        return np.zeros((0, 3), dtype=np.int64)
    order = np.lexsort((begins, rows))
    rows, begins, ends = rows[order], begins[order], ends[order]
    reach = np.maximum.accumulate(ends)  # rows follow one another, so earlier rows never reach a later one
    heads = np.append(True, (rows[1:] != rows[:-1]) | (begins[1:] > reach[:-1]))
    where = np.flatnonzero(heads)
    return np.stack([rows[where], begins[where], np.maximum.reduceat(ends, where)], axis=1)


REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"


def remove_repeats(docs: DataFrame, *, width: int = WIDTH) -> DataFrame:
    """For each row of ``docs(doc_id, text)`` the bytes that stay, their SHA-256, and how much went."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for item in _rows(batches):
            ids, offsets, data = _unpacked(item)
            raw, gone = data.tobytes(), np.frombuffer(item["spans"], dtype="<i8").reshape(-1, 3).tolist()
            kept, removed, counts, at = [], [0] * len(ids), [0] * len(ids), 0
            for r, (begin, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                parts = []
                while at < len(gone) and gone[at][0] == r:
                    parts.append(raw[begin : gone[at][1]])
                    begin = gone[at][2]
                    removed[r] += gone[at][2] - gone[at][1]
                    counts[r] += 1
                    at += 1
                kept.append(b"".join([*parts, raw[begin:end]]))
            numbers = pa.array(ids, mask=ids == NULL_ID)
            yield pa.RecordBatch.from_arrays(
                [numbers, pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(kept, pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
            )

    return repeated_spans(docs, width=width).mapInArrow(cut, REMOVED)


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
