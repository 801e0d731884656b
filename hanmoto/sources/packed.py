"""Packed corpus files as a data source: ``spark.read.format("packed_corpus")`` reads ranges of entries, and only the labels asked for.

``register(spark)`` makes the format known. A read plans from the indexes alone, which it streams: stretches of entries of about ``rangeBytes`` of
payload (64 MB if not given) become tasks, each of which reads its part of the index and its part of the payload, so that a file may be of any
size. Filters of ``label`` (equal, in, starts with) drop stretches without a match in planning and entries in reading. A write makes one file
for each task in a folder of its own beside the target's files, and moves them there when all tasks are done, so that a failed or
repeated task leaves nothing. Payloads are compressed unless the option ``zstd`` is false; ``level`` is the level, 3 if not given.

Paths are those that ``pyarrow.fs`` opens (file, hdfs, s3, gs, abfs); what only Spark's own readers open goes through ``corpus.read_packed``.
Files that aren't packed corpora of version 1, and entries outside their file or over the largest size, raise. An empty table writes no file;
null labels and contents are written as empty ones.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage

from .corpus import _ENTRY, _HEAD, ARCHIVE, LARGEST, MAGIC, UTF8, VERSION, ZSTD

RANGE, PIECE, ROWS = 64 << 20, 1 << 22, 256


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


def _index(file, at: int, count: int, size: int) -> Iterator[tuple[int, tuple]]:
    """(place in the file, (payload's place, bytes, decoded bytes, time, hash, label)) of entries, read in pieces."""
    data, begin = b"", at
    for _ in range(count):
        place = at - begin
        while len(data) < place + _ENTRY.size or len(data) < place + _ENTRY.size + _ENTRY.unpack_from(data, place)[5]:
            more = file.read_at(min(PIECE, size - begin - len(data)), begin + len(data))
            if not more:
                raise ValueError("the index ends outside the file")
            data, begin, place = data[place:] + more, at, 0
        payload, n, decoded, mtime, digest, length = _ENTRY.unpack_from(data, place)
        label = data[place + _ENTRY.size : place + _ENTRY.size + length].decode()
        if payload + n > size or decoded > LARGEST:
            raise ValueError(f"the entry {label} lies outside the file or is too large")
        yield at, (payload, n, decoded, mtime, digest, label)
        at += _ENTRY.size + length


@dataclass
class Stretch(InputPartition):
    """Entries of one file that follow one another."""

    path: str
    flags: int
    at: int
    count: int
    wanted: int


class PackedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.range = options["path"], int(options.get("rangeBytes", RANGE))
        self.tests: list[tuple[str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("label",):
                self.tests.append(("in", [f.value]))
            elif isinstance(f, In) and f.attribute == ("label",):
                self.tests.append(("in", list(f.value)))
            elif isinstance(f, StringStartsWith) and f.attribute == ("label",):
                self.tests.append(("begins", f.value))
            else:
                yield f

    def _asked(self, label: str) -> bool:
        return all(label in v if how == "in" else label.startswith(v) for how, v in self.tests)

    def partitions(self) -> list[Stretch]:
        from pyarrow import fs

        system, root = _open(self.path)
        info = system.get_file_info(root)
        files = [info] if info.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
        out = []
        for f in sorted(files, key=lambda f: f.path):
            with system.open_input_file(f.path) as file:
                head = file.read_at(_HEAD.size, 0)
                magic, version, flags, count = _HEAD.unpack(head) if len(head) == _HEAD.size else (b"", 0, 0, 0)
                if magic != MAGIC or version != VERSION:
                    raise ValueError(f"{f.path} is not a packed corpus of version 1")
                begin, n, wanted, size = _HEAD.size, 0, 0, 0
                for at, (_, length, *_, label) in _index(file, _HEAD.size, count, f.size):
                    if n and size + length > self.range:
                        out.append(Stretch(f.path, flags, begin, n, wanted))
                        begin, n, wanted, size = at, 0, 0, 0
                    n, wanted, size = n + 1, wanted + self._asked(label), size + length
                out.append(Stretch(f.path, flags, begin, n, wanted))
        return [s for s in out if s.wanted] or [Stretch("", 0, 0, 0, 0)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        system, _ = _open(self.path)
        kinds = [pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
        names = [x.split()[0] for x in ARCHIVE.split(", ")]
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        decoder, rows, held = zstandard.ZstdDecompressor(), [], 0
        with system.open_input_file(partition.path) as file:
            size = file.size()
            for _, (place, n, decoded, mtime, digest, label) in _index(file, partition.at, partition.count, size):
                if not self._asked(label):
                    continue
                raw = file.read_at(n, place)
                rows.append((label, mtime, digest, decoded, n, decoder.decompress(raw, max_output_size=decoded or 1) if partition.flags & ZSTD else raw))
                held += decoded
                if len(rows) == ROWS or held > PIECE:
                    yield batch(rows)
                    rows, held = [], 0
        if rows:
            yield batch(rows)


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class PackedWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite, self.level = options["path"], overwrite, int(options.get("level", 3))
        self.flags = UTF8 | (ZSTD if options.get("zstd", "true").lower() != "false" else 0)
        self.work = f"_writing-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, root = _open(self.path)
        name, index, at = f"part-{uuid.uuid4().hex}.bin", [], 0
        system.create_dir(f"{root}/{self.work}", recursive=True)
        encoder, body = zstandard.ZstdCompressor(level=self.level), f"{root}/{self.work}/{name}.payload"
        with system.open_output_stream(body) as out:
            for b in batches:
                for r in b.select(["label", "mtime_ns", "source_hash", "payload"]).to_pylist():
                    content, label = r["payload"] or b"", (r["label"] or "").encode()
                    if len(content) > LARGEST:
                        raise ValueError(f"the entry {r['label']} is too large")
                    raw = encoder.compress(content) if self.flags & ZSTD else content
                    out.write(raw)
                    index.append((at, len(raw), len(content), r["mtime_ns"] or 0, r["source_hash"] or hashlib.sha256(content).digest(), label))
                    at += len(raw)
        if index:
            before = _HEAD.size + sum(_ENTRY.size + len(e[5]) for e in index)
            with system.open_output_stream(f"{root}/{self.work}/{name}") as out, system.open_input_stream(body) as payload:
                out.write(_HEAD.pack(MAGIC, VERSION, self.flags, len(index)))
                for place, *rest, label in index:
                    out.write(_ENTRY.pack(before + place, *rest, len(label)) + label)
                while piece := payload.read(PIECE):
                    out.write(piece)
        system.delete_file(body)
        return Written(name if index else None)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(root)):
                if f.type == fs.FileType.File:
                    system.delete_file(f.path)
        for m in messages:
            if m and m.name:
                system.move(f"{root}/{self.work}/{m.name}", f"{root}/{m.name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, root = _open(self.path)
        if system.get_file_info(f"{root}/{self.work}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.work}")


class PackedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "packed_corpus"

    def schema(self) -> str:
        return ARCHIVE

    def reader(self, schema) -> PackedReader:
        return PackedReader(self.options)

    def writer(self, schema, overwrite: bool) -> PackedWriter:
        return PackedWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known and lets Spark hand filters to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PackedSource)
