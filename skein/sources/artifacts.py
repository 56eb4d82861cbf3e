"""Index artifacts as data sources: vector files with their chunks, and bundles of files, in parts under one manifest.

Tasks write parts with names of their own, each no larger than ``part_bytes`` before compression but for a row that is
larger alone. When all tasks have ended, the driver puts a new ``manifest.json`` in place of the old one, which
is the only file that it writes: a reader sees all of a write or nothing of it. Parts of failed tasks are in no manifest and
are deleted when the write ends either way. A reader's task gets parts of ``READ_BYTES`` together, one after another, or a larger part alone.

``vector_parts`` holds ``chunk string, embedding array<float>``: for each part ``vectors-*.bin``, two unsigned 32-bit
counts and then 32-bit floats, and ``chunks-*.jsonl``, a line for each vector. ``bundle_parts`` holds ``name string, content
binary`` as ``part-*.tar.zst``. Null contents, embeddings and chunks are errors of the task that meets them, as are
embeddings of different lengths in one part.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

PART_BYTES = 2_000_000_000
#: Contents of the parts that one task reads, and of the files of a bundle that leave it at once.
READ_BYTES = 8_000_000
BATCH_BYTES = 1_000_000
MANIFEST = "manifest.json"


def _open(path: str):
    """(file system, folder) of a path or URI."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), path


def read_manifest(path: str) -> dict[str, Any]:
    """What a folder of parts holds; nothing where none was written."""
    files, base = _open(path)
    if files.get_file_info(f"{base}/{MANIFEST}").type.name == "NotFound":
        return {"parts": [], "rows": 0, "bytes": 0}
    with files.open_input_stream(f"{base}/{MANIFEST}") as file:
        return json.loads(file.read())


@dataclass
class Part:
    """One part: its files, rows, bytes before compression, and the SHA-256 of each file."""

    value: Any = None
    files: dict[str, str] = field(default_factory=dict)
    rows: int = 0
    size: int = 0


@dataclass
class Dealt(InputPartition):
    """Parts that one task reads."""

    value: Any = None
    parts: list[Part] = field(default_factory=list)


@dataclass
class Written(WriterCommitMessage):
    parts: list[Part]


class _Format:
    """How rows become the files of a part, and back."""

    schema = ""

    def size(self, row: tuple) -> int:
        raise NotImplementedError

    def encode(self, rows: list[tuple]) -> dict[str, bytes]:
        """Contents of the files of a part by the pattern of their names."""
        raise NotImplementedError

    def decode(self, contents: dict[str, bytes]) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError


class _Vectors(_Format):
    schema = "chunk string, embedding array<float>"

    def size(self, row):
        return len(row[0]) + 4 * len(row[1])

    def encode(self, rows):
        values = np.array([r[1] for r in rows], dtype="<f4")
        head = struct.pack("<II", len(rows), values.shape[1] if values.ndim == 2 else 0)
        lines = "".join(json.dumps(json.loads(r[0]), ensure_ascii=False, separators=(",", ":")) + "\n" for r in rows)
        return {"vectors-{}.bin": head + values.tobytes(), "chunks-{}.jsonl": lines.encode()}

    def decode(self, contents):
        data = next(c for n, c in contents.items() if n.startswith("vectors-"))
        lines = next(c for n, c in contents.items() if n.startswith("chunks-")).decode().splitlines()
        n, dimensions = struct.unpack("<II", data[:8])
        if len(data) != 8 + 4 * n * dimensions or len(lines) != n:
            raise ValueError(f"a part of {n} vectors has {len(data)} bytes and {len(lines)} chunks")
        values = pa.array(np.frombuffer(data[8:], dtype="<f4"))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dimensions), values)
        for a in range(0, n, 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(lines[a : a + 10_000], pa.string()), lists.slice(a, 10_000)], names=["chunk", "embedding"])


class _Bundle(_Format):
    schema = "name string, content binary"

    def size(self, row):
        return len(row[0]) + len(row[1])

    def encode(self, rows):
        import zstandard

        raw = io.BytesIO()
        with tarfile.open(fileobj=raw, mode="w", format=tarfile.PAX_FORMAT) as tar:
            for name, content in rows:
                member = tarfile.TarInfo(name)
                member.size = len(content)
                tar.addfile(member, io.BytesIO(content))
        return {"part-{}.tar.zst": zstandard.ZstdCompressor().compress(raw.getvalue())}

    def decode(self, contents):
        import zstandard

        (data,) = contents.values()
        with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data)) as raw, tarfile.open(fileobj=raw, mode="r|") as tar:
            names, files, size = [], [], 0
            batch = lambda: pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string()), "content": pa.array(files, pa.binary())})
            for member in tar:
                if names and size + member.size > BATCH_BYTES:
                    yield batch()
                    names, files, size = [], [], 0
                file = tar.extractfile(member)
                names.append(member.name)
                files.append(file.read() if file else b"")
                size += len(member.name) + member.size
            if names:
                yield batch()


class PartsWriter(DataSourceArrowWriter):
    def __init__(self, form: _Format, path: str, part_bytes: int, overwrite: bool):
        self.form, self.path, self.part_bytes, self.overwrite = form, path, part_bytes, overwrite
        self.run = uuid.uuid4().hex[:12]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        files, base = _open(self.path)
        files.create_dir(base, recursive=True)
        parts: list[Part] = []
        rows, size = [], 0

        def close() -> None:
            nonlocal rows, size
            if not rows:
                return
            number = f"{self.run}-{task.partitionId():05}-{task.taskAttemptId()}-{len(parts):03}"
            sums = {}
            for pattern, content in self.form.encode(rows).items():
                name = pattern.format(number)
                with files.open_output_stream(f"{base}/{name}") as file:
                    file.write(content)
                sums[name] = hashlib.sha256(content).hexdigest()
            parts.append(Part(number, sums, len(rows), size))
            rows, size = [], 0

        for batch in iterator:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if None in row:
                    raise ValueError("parts hold no nulls")
                more = self.form.size(row)
                if rows and size + more > self.part_bytes:
                    close()
                rows.append(row)
                size += more
        close()
        return Written(parts)

    def commit(self, messages: list[Written | None]) -> None:
        files, base = _open(self.path)
        files.create_dir(base, recursive=True)
        before = read_manifest(self.path)["parts"]
        new = [vars(p) for m in messages if m for p in m.parts]
        parts = new if self.overwrite else [*before, *new]
        whole = {"parts": parts, "rows": sum(p["rows"] for p in parts), "bytes": sum(p["size"] for p in parts)}
        with files.open_output_stream(f"{base}/_{MANIFEST}.{self.run}") as file:
            file.write(json.dumps(whole, indent=1).encode())
        files.move(f"{base}/_{MANIFEST}.{self.run}", f"{base}/{MANIFEST}")
        gone = {n for p in before for n in p["files"]} if self.overwrite else set()
        self._clear({n for p in parts for n in p["files"]}, gone)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(set(), set())

    def _clear(self, kept: set[str], gone: set[str]) -> None:
        """Delete what tasks of this run have left and nothing names, and what it has replaced."""
        from pyarrow import fs

        files, base = _open(self.path)
        for info in files.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            name = info.base_name
            if name not in kept and (self.run in name or name in gone):
                files.delete_file(info.path)


class PartsReader(DataSourceReader):
    def __init__(self, form: _Format, path: str):
        self.form, self.path = form, path

    def partitions(self) -> list[Dealt]:
        dealt, size = [Dealt()], 0
        for part in (Part(**p) for p in read_manifest(self.path)["parts"]):
            if dealt[-1].parts and size + part.size > READ_BYTES:
                dealt.append(Dealt())
                size = 0
            dealt[-1].parts.append(part)
            size += part.size
        return dealt

    def read(self, partition: Dealt) -> Iterator[pa.RecordBatch]:
        files, base = _open(self.path)
        for part in partition.parts:
            contents = {}
            for name, wanted in part.files.items():
                with files.open_input_stream(f"{base}/{name}") as file:
                    contents[name] = file.read()
                if hashlib.sha256(contents[name]).hexdigest() != wanted:
                    raise ValueError(f"{name} is not what its manifest says")
            yield from self.form.decode(contents)


class _Parts(DataSource):
    form: type[_Format] = _Format

    def schema(self) -> str:
        return self.form.schema

    def reader(self, schema: Any) -> PartsReader:
        return PartsReader(self.form(), self.options["path"])

    def writer(self, schema: Any, overwrite: bool) -> PartsWriter:
        return PartsWriter(self.form(), self.options["path"], int(self.options.get("part_bytes", PART_BYTES)), overwrite)


class VectorParts(_Parts):
    form = _Vectors

    @classmethod
    def name(cls) -> str:
        return "vector_parts"


class BundleParts(_Parts):
    form = _Bundle

    @classmethod
    def name(cls) -> str:
        return "bundle_parts"


def write_parts(rows: DataFrame, kind: type[_Parts], path: str, *, mode: str = "overwrite", part_bytes: int = PART_BYTES) -> None:
    """Write ``rows``, which have the kind's columns, in its order."""
    rows.sparkSession.dataSource.register(kind)
    columns = [c.split()[0] for c in kind.form.schema.split(", ")]
    rows.select(*columns).write.format(kind.name()).mode(mode).option("part_bytes", part_bytes).save(path)


def read_parts(spark: SparkSession, kind: type[_Parts], path: str) -> DataFrame:
    spark.dataSource.register(kind)
    return spark.read.format(kind.name()).load(path)


def write_lines(rows: DataFrame, path: str) -> None:
    """Rows as lines of JSON, nulls left out: the exchange form of symbols and of the edges of a repository map."""
    rows.write.mode("overwrite").json(path)
