"""WARC archives with a Merkle fixity audit.

Archives: each task writes the pages that it reads as WARC/1.1 records, a new file whenever ``file_bytes``
are full, by Spark's text writer with the record end as separator and gzip around each file. No page
is shuffled. A file is read back whole by one task, which finds the record boundaries in its bytes;
offsets count the bytes inside the gzip. What a damaged gzip still gives up to the damage is read.

Audit: records are told from the bytes of a replica's files, with the byte offset and length where they
stand; what their headers say takes no part. A leaf hashes offset, length and digest of one record. Nodes
are ordered offset ranges: a leaf lies in the range of ``LEAF_BYTES`` where it starts, a node hashes the
range it covers and its children in the order of their offsets, ``fanout`` at most above the first level;
the root covers the whole file. A damaged byte so changes one leaf, and a shifted or swapped record its
place. Two replicas are compared from the roots down: only children of nodes that differ are looked at, so
an intact archive costs one comparison of roots. Leaves that differ are then matched: with the same offset
they are damaged, a digest at another offset is moved, others are missing or added; a record that stands
twice is one more at its second offset, and added.

Defined results: null urls and bodies are written as empty; records whose text holds the record
boundary are written in base64; pages that share a ``page_id`` are separate records; a page longer than
``file_bytes`` has a file of its own; a record whose header is damaged is still a record, told by its
place, without ``page_id``; empty tables give empty archives; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.storage import new_path, removed, saved

RECORD_END = "\r\n\r\n"
VERSION = "WARC/1.1\r\n"
FANOUT = 16
#: Bytes of a file before compression; a task holds one file.
FILE_BYTES = 32 << 20
#: Bytes of a range of leaves.
LEAF_BYTES = 1 << 15
_BOUNDARY = (RECORD_END + VERSION).encode()
_PAGE = re.compile(rb"WARC-Record-ID: <urn:skein:page:(-?\d+):")


def to_records(pages: DataFrame, *, file_bytes: int = FILE_BYTES) -> DataFrame:
    """(file, seq, record): the pages' WARC records and their places, a file's records in one task."""

    def record(page_id: int | None, url: str | None, body: str | None, nth: int) -> bytes:
        url, body, kind = re.sub(r"[\r\n]", " ", url or ""), (body or "").encode(), ""
        if _BOUNDARY in body or body.endswith(_BOUNDARY[:-2]):
            body, kind = base64.b64encode(body), "Content-Transfer-Encoding: base64\r\n"
        head = f"{VERSION}WARC-Type: resource\r\nWARC-Record-ID: <urn:skein:page:{'null' if page_id is None else page_id}:{nth}>\r\nWARC-Target-URI: {url}\r\n"
        return f"{head}WARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: text/html; charset=utf-8\r\n{kind}Content-Length: {len(body)}\r\n\r\n".encode() + body

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, held, seq, nth = 0, 0, 0, 0
        for batch in batches:
            files, places, records = [], [], []
            for task, page_id, url, body in zip(*(batch[c].to_pylist() for c in ("task", "page_id", "url", "html")), strict=True):
                one = record(page_id, url, body, nth)
                if held and held + len(one) > file_bytes:
                    file, held, seq = file + 1, 0, 0
                files.append(f"{task:06d}-{file:06d}")
                places.append(seq)
                records.append(one)
                held, seq, nth = held + len(one) + len(RECORD_END), seq + 1, nth + 1
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(places, pa.int64()), pa.array(records, pa.binary())], names=["file", "seq", "record"])

    told_of = pages.select(F.spark_partition_id().alias("task"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return told_of.mapInArrow(told, "file string, seq long, record binary")


def write_archive(records: DataFrame, path: str) -> None:
    """One folder for each file, each with one part: the file's ``records(file, seq, record)`` in order.

    The records of a file stand in one partition.
    """
    dealt = records.select("file", "seq", F.col("record").cast("string").alias("value")).sortWithinPartitions("file", "seq")
    dealt.select("file", "value").write.partitionBy("file").option("lineSep", RECORD_END).option("compression", "gzip").text(path)


def _inside(content: bytes) -> bytes:
    """A file's bytes without the gzip around them, up to where that is damaged."""
    if content[:2] != b"\x1f\x8b":
        return content
    reader, parts = zlib.decompressobj(31), []
    try:
        for k in range(0, len(content), 1 << 16):
            parts.append(reader.decompress(content[k : k + (1 << 16)]))
    except zlib.error:
        pass
    return b"".join(parts)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes, list[tuple[int, int]]]]:
    """(file, bytes, where each record begins and ends) of files read whole."""
    for batch in batches:
        for where, content in zip(batch["path"], batch["content"], strict=True):
            name = re.search(r"/file=([^/]+)/[^/]*$", where.as_py()).group(1)
            whole = _inside(content.as_py())
            starts, at = [0] if whole else [], whole.find(_BOUNDARY)
            while at >= 0:
                starts.append(at + len(RECORD_END))
                at = whole.find(_BOUNDARY, at + len(RECORD_END))
            yield name, whole, list(zip(starts, [*starts[1:], len(whole)], strict=True)) if starts else []


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, length, digest, seq, page_id) of the records as they stand in the files' bytes.

    ``page_id`` is what the record's header says, for reports only.
    """

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, whole, places in _records(batches):
            data = memoryview(whole)
            digests = [hashlib.sha256(data[i:j]).hexdigest() for i, j in places]
            pages = [m and int(m.group(1)) for m in (_PAGE.search(data[i : min(j, i + 256)]) for i, j in places)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(places), pa.string()), pa.array([i for i, _ in places], pa.int64()), pa.array([j - i for i, j in places], pa.int64()), pa.array(digests, pa.string()), pa.array(range(len(places)), pa.int64()), pa.array(pages, pa.int64())],
                names=["file", "offset", "length", "digest", "seq", "page_id"],
            )

    return _files(spark, path).mapInArrow(told, "file string, offset long, length long, digest string, seq long, page_id long")


def archived_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, seq, record) of an archive, a file's records in one task."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, whole, places in _records(batches):
            records = [whole[i:j].removesuffix(RECORD_END.encode()) for i, j in places]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(places), pa.string()), pa.array(range(len(places)), pa.int64()), pa.array(records, pa.binary())], names=["file", "seq", "record"])

    return _files(spark, path).mapInArrow(told, "file string, seq long, record binary")


def leaves(records: DataFrame) -> DataFrame:
    """Level 0: (file, node, start, end, digest) with one node for each record, at its offset."""
    end = F.col("offset") + F.col("length")
    digest = F.sha2(F.concat_ws(":", F.col("offset").cast("string"), F.col("length").cast("string"), "digest"), 256)
    return records.select("file", F.col("offset").alias("node"), F.col("offset").alias("start"), end.alias("end"), digest.alias("digest"))


def tree(records: DataFrame, *, fanout: int = FANOUT, levels: int) -> list[DataFrame]:
    """All levels from the leaves to the roots.

    Node ``n`` of level 1 covers the records that start from ``n * LEAF_BYTES``, of a higher level the
    children from ``n * fanout``, of the last one the whole file.
    """
    level = saved(leaves(records), "level-0")
    out = [level]
    for k in range(1, levels):
        children = F.array_sort(F.collect_list(F.struct("start", "end", "digest")))
        joined = F.concat_ws("|", F.transform(children, lambda c: F.concat_ws("=", c["start"].cast("string"), c["end"].cast("string"), c["digest"])))
        covered = F.concat_ws("-", F.min("start").cast("string"), F.max("end").cast("string"))
        hashed = F.sha2(F.concat_ws("#", covered, joined), 256)
        level = saved(level.groupBy("file", parent(k, levels, fanout).alias("node")).agg(F.min("start").alias("start"), F.max("end").alias("end"), hashed.alias("digest")), f"level-{k}")
        out.append(level)
    return out


def parent(level: int, levels: int, fanout: int = FANOUT) -> Column:
    """Node of ``level`` above a ``node`` of the level below."""
    if level == levels - 1:
        return F.lit(0).cast("long")
    return F.floor(F.col("node") / (LEAF_BYTES if level == 1 else fanout))


def depth(longest_file: int, fanout: int = FANOUT) -> int:
    """Levels of a tree over files of so many bytes."""
    levels, span = 2, LEAF_BYTES
    while span < longest_file:
        span *= fanout
        levels += 1
    return levels


def audit(primary: list[DataFrame], replica: list[DataFrame], *, fanout: int = FANOUT) -> DataFrame:
    """(file, offset, digest) of leaves that differ, from the roots down, and ``side``: a or b."""
    suspects, levels = None, len(primary)
    for k in range(levels - 1, -1, -1):
        left, right = primary[k], replica[k]
        if suspects is not None:
            parents = suspects.select(F.col("file").alias("f"), F.col("node").alias("n")).distinct()

            def under(x: DataFrame, k: int = k, parents: DataFrame = parents) -> DataFrame:
                x = x.withColumn("up", parent(k + 1, levels, fanout))
                return x.join(parents, (x.file == F.col("f")) & (x.up == F.col("n")), "left_semi")

            left, right = under(left), under(right)
        both = left.select("file", "node", F.col("digest").alias("da")).join(right.select("file", "node", F.col("digest").alias("db")), ["file", "node"], "full")
        suspects = saved(both.where("not (da <=> db)"), "suspects")
    return suspects.select("file", F.col("node").alias("offset"), F.col("da").isNotNull().alias("in_primary"), F.col("db").isNotNull().alias("in_replica"))


def compare(primary: DataFrame, replica: DataFrame, found: DataFrame) -> DataFrame:
    """(file, offset, length, digest, status) of records that differ; ``added`` ones have the replica's place.

    Copies of a digest in a file are matched in the order of their offsets, so a second copy is left over.
    """
    order = Window.partitionBy("file", "digest").orderBy("offset")
    a = primary.join(found.where("in_primary").select("file", "offset"), ["file", "offset"])
    b = replica.join(found.where("in_replica").select("file", "offset"), ["file", "offset"])
    a, b = a.withColumn("nth", F.row_number().over(order)), b.withColumn("nth", F.row_number().over(order))
    kept = b.select("file", "digest", "nth")
    a = saved(a.join(kept.withColumn("moved", F.lit(True)), ["file", "digest", "nth"], "left"), "lost")
    more = b.join(a.select("file", "digest", "nth"), ["file", "digest", "nth"], "left_anti")
    more = saved(more.select("file", "offset", "length", "digest"), "more")
    lost = a.where("moved is null").select("file", "offset", "length", "digest")
    # what is neither whole elsewhere nor at its offset: the nth lost record of a gap is the nth new one
    # between the same neighbours, which did not change or only moved
    still = replica.join(more, ["file", "offset"], "left_anti")
    same = Window.partitionBy("file", "digest").orderBy("offset")
    rank = lambda x: x.withColumn("nth", F.row_number().over(same))
    stayed = rank(primary.join(lost, ["file", "offset"], "left_anti")).select("file", "digest", "nth", F.col("offset").alias("at_a"))
    stayed = stayed.join(rank(still).select("file", "digest", "nth", F.col("offset").alias("at_b")), ["file", "digest", "nth"])
    before = lambda x, at: _gaps(x, stayed.select("file", F.col(at).alias("offset"), F.col("at_a").alias("gap")))
    lost, more = before(lost, "at_a"), before(more, "at_b")
    paired = lost.join(more.select("file", "gap", "nth", F.lit(True).alias("paired")), ["file", "gap", "nth"], "left")
    left_over = more.join(lost.select("file", "gap", "nth"), ["file", "gap", "nth"], "left_anti")
    told = ["file", "offset", "length", "digest"]
    return (
        paired.select(*told, F.when(F.col("paired"), "damaged").otherwise("missing").alias("status"))
        .union(a.where("moved").select(*told, F.lit("moved").alias("status")))
        .union(left_over.select(*told, F.lit("added").alias("status")))
    )


def _gaps(rows: DataFrame, stayed: DataFrame) -> DataFrame:
    """``rows`` with ``gap``, the primary's offset of the last record before them that stayed, and ``nth`` in it."""
    marked = rows.withColumn("gap", F.lit(None).cast("long")).unionByName(stayed.select("file", "offset", F.lit(None).cast("long").alias("length"), F.lit(None).cast("string").alias("digest"), "gap"))
    # a file holds RECORDS_PER_FILE records and what was added
    up_to = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    known = marked.withColumn("gap", F.coalesce(F.last("gap", ignorenulls=True).over(up_to), F.lit(-1))).where("length is not null")
    return known.withColumn("nth", F.row_number().over(Window.partitionBy("file", "gap").orderBy("offset")))


def damage(records: DataFrame, every: int = 97) -> DataFrame:
    """A replica with known faults, for rehearsing an audit: flipped characters, lost records, records
    written twice, swapped with the next one, and lengthened so that later ones are shifted.

    Which ones follows from a hash of each record's place.
    """
    dice = F.pmod(F.xxhash64("file", "seq"), F.lit(every))
    text = F.col("record").cast("string")
    flipped = F.concat(F.left(text, F.length(text) - 1), F.when(F.right(text, F.lit(1)) == "#", "@").otherwise("#"))
    changed = F.when(dice == 0, flipped).when(dice == 4, F.concat(text, F.lit("#"))).otherwise(text)
    # places in tenths: a swapped record goes behind the next one, a second copy right behind the first
    at = F.col("seq") * 10
    places = F.when(dice == 2, F.array(at, at + 1)).when(dice == 3, F.array(at + 12)).otherwise(F.array(at))
    return records.where(dice != 1).select("file", F.explode(places).alias("seq"), changed.alias("record"))


def op8_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages twice, one replica with rehearsed faults, and locate these from both roots.

    Places, lengths and digests are those read back from the archive's bytes; ``page_id`` is null for added records.
    """
    paths = [new_path(spark, f"replica-{k}") for k in "ab"]
    write_archive(to_records(spark.read.parquet(f"{sf_dir}/pages.parquet")), paths[0])
    write_archive(damage(archived_records(spark, paths[0])), paths[1])
    read = [saved(read_archive(spark, p), "read") for p in paths]
    for path in paths:  # the audit works on what was read
        removed(spark, path)
    longest = max(r.agg(F.max(F.col("offset") + F.col("length"))).first()[0] or 0 for r in read)
    trees = [tree(r, levels=depth(longest)) for r in read]
    found = compare(*read, audit(*trees))
    roots = trees[0][-1].select("file", F.col("digest").alias("file_root"))
    told = read[0].join(found.where("status != 'added'").select("file", "offset", "status"), ["file", "offset"], "left").withColumn("status", F.coalesce("status", F.lit("intact")))
    told = told.unionByName(found.where("status = 'added'"), allowMissingColumns=True)
    return told.join(roots, "file", "left").select("page_id", "file", "seq", "offset", "length", F.col("digest").alias("sha256"), "file_root", "status")
