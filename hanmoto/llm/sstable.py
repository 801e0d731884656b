"""Token ids in sorted-string-table shards.

A shard file holds data blocks, a block index, a Bloom filter and a footer, in this order. Keys are document ids as bytes
that sort like the numbers. A block's entries carry how many bytes their key shares with the key before; the index has each block's
first key, place and the ids before it, so a lookup asks the filter, searches the index and reads one block.

Integers in entries and index are LEB128 varints. An entry: shared, unshared, value length, key rest, value. A value: the ids,
little-endian, of the width in the footer.

Tasks write shards to the shared folder under names of their own and give a manifest row for each; only files in the written manifest
count, so a task that runs twice does no harm.

Defined results: a null text is empty and gives the end id alone; null ids come first; repeated ids stay, ordered by text hash; an empty
table gives an empty manifest and no files; other columns are ignored.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, new_path, running_total, tasks
from .tokens import encoder

MAGIC, VERSION = b"HSST", 1
#: Bytes of a block and of a shard; filter bits for each key and hashes.
BLOCK, SHARD, BITS, HASHES = 32 << 10, 8 << 20, 10, 7
FOOTER = struct.Struct("<4sHHQQQQQQI")  # magic, version, width, index at, index bytes, filter at, filter bytes, entries, ids, crc32 of index and filter


def to_key(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + (doc_id + (1 << 63)).to_bytes(8, "big")


def from_key(key: bytes) -> int | None:
    return None if key == b"\0" else int.from_bytes(key[1:], "big") - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _places(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh64_intdigest(key)
    a, b = h & 0xFFFFFFFF, h >> 32 | 1
    return [(a + i * b) % bits for i in range(HASHES)]


class Writer:
    """Collects one shard; keys must come in ascending order."""

    def __init__(self, width: int):
        self.width, self.data, self.index, self.keys = width, bytearray(), [], []
        self.block_at, self.before, self.ids, self.last = 0, b"", 0, b""

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if not self.index or len(self.data) - self.block_at >= BLOCK:
            self.block_at, self.before = len(self.data), b""
            self.index.append((key, self.block_at, self.ids))
        shared = 0
        for a, b in zip(self.before, key, strict=False):
            if a != b:
                break
            shared += 1
        value = ids.astype(f"<u{self.width}").tobytes()
        self.data += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.before = key
        self.keys.append(key)
        self.ids += len(ids)

    def finish(self) -> bytes:
        index = b"".join(_varint(len(k)) + k + _varint(at) + _varint(n) for k, at, n in self.index)
        bits = max(64, BITS * len(self.keys))
        bloom = bytearray(-(-bits // 8))
        for k in self.keys:
            for p in _places(k, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        at = len(self.data)
        tail = index + struct.pack("<Q", bits) + bytes(bloom)
        return bytes(self.data) + tail + FOOTER.pack(MAGIC, VERSION, self.width, at, len(index), at + len(index), len(tail) - len(index), len(self.keys), self.ids, zlib.crc32(tail))


class Reader:
    """A shard's bytes (or anything that can be sliced like them)."""

    def __init__(self, data):
        self.data = data
        magic, version, self.width, at, n, bloom_at, bloom_n, self.entries, self.ids, crc = FOOTER.unpack(bytes(data[len(data) - FOOTER.size :]))
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a shard of this format")
        tail = bytes(data[at : bloom_at + bloom_n])
        if zlib.crc32(tail) != crc:
            raise ValueError("the shard's index is damaged")
        self.end, self.bits = at, struct.unpack_from("<Q", tail, n)[0]
        self.bloom, self.first, self.at, self.before = tail[n + 8 :], [], [], []
        i = 0
        while i < n:
            k, i = _read_varint(tail, i)
            self.first.append(tail[i : i + k])
            i += k
            place, i = _read_varint(tail, i)
            ids, i = _read_varint(tail, i)
            self.at.append(place)
            self.before.append(ids)

    def block(self, b: int) -> Iterator[tuple[bytes, int, np.ndarray]]:
        """Key, ids before it in the shard, ids."""
        end = self.at[b + 1] if b + 1 < len(self.at) else self.end
        data, i, key, start = bytes(self.data[self.at[b] : end]), 0, b"", self.before[b]
        while i < len(data):
            shared, i = _read_varint(data, i)
            own, i = _read_varint(data, i)
            n, i = _read_varint(data, i)
            key = key[:shared] + data[i : i + own]
            i += own
            ids = np.frombuffer(data, f"<u{self.width}", n // self.width, i)
            i += n
            yield key, start, ids
            start += len(ids)

    def __iter__(self) -> Iterator[tuple[bytes, int, np.ndarray]]:
        for b in range(len(self.at)):
            yield from self.block(b)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each document of that id; none if it isn't there."""
        key = to_key(doc_id)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _places(key, self.bits)):
            return []
        b = max(0, bisect.bisect_left(self.first, key) - 1)  # equal keys may begin in the block before
        out = []
        while b < len(self.first) and self.first[b] <= key:
            out += [ids for k, _, ids in self.block(b) if k == key]
            b += 1
        return out


def write_shards(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", end_id: int = 1, out: str | None = None) -> tuple[str, DataFrame]:
    """Encodes and writes all documents in ascending order of ``key``; gives the folder and the manifest ``shard, name, entries, ids``, one row a file.

    ``shard`` ascends with the keys. Texts are shuffled once, by key ranges.
    """
    spark = docs.sparkSession
    folder = out or new_path(spark, "sstable")
    target = folder if "://" in folder else folder.removeprefix("file:")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, end_id)
        width = 2 if enc.tokenizer.get_vocab_size() <= 1 << 16 else 4
        fs, root = pyarrow.fs.FileSystem.from_uri(target)
        fs.create_dir(root, recursive=True)
        part, n, w = TaskContext.get().partitionId(), 0, None

        def close() -> pa.RecordBatch:
            name = f"{part:08d}-{n:08d}-{uuid.uuid4().hex}.sst"
            with fs.open_output_stream(f"{root}/{name}") as stream:
                stream.write(w.finish())
            return pa.record_batch([pa.array([(part << 32) + n]), pa.array([name]), pa.array([len(w.keys)]), pa.array([w.ids])], ["shard", "name", "entries", "ids"])

        for b in batches:
            for lo in range(0, b.num_rows, 500):
                sub = b.slice(lo, 500)
                for doc_id, ids in zip(sub.column(0).to_pylist(), enc.encode(sub.column(1).to_pylist()), strict=True):
                    w = w or Writer(width)
                    w.add(to_key(doc_id), ids)
                    if len(w.data) >= SHARD:
                        yield close()
                        n, w = n + 1, None
        if w:
            yield close()

    kept = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).repartitionByRange(tasks(spark), F.col("_key").asc_nulls_first())
    placed = kept.sortWithinPartitions(F.col("_key").asc_nulls_first(), F.xxhash64("_text"))
    return folder, materialize(placed.mapInArrow(f, "shard long, name string, entries long, ids long"), "manifest")


def read_shards(spark, folder: str, manifest: DataFrame) -> DataFrame:
    """``doc_id, start, ids``: all documents of the manifest's files with the ids of all documents before them."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                reader = Reader(memoryview(data.as_buffer()))
                for i in range(len(reader.at)):
                    rows = list(reader.block(i))
                    yield pa.record_batch([pa.array([name] * len(rows)), pa.array([from_key(k) for k, _, _ in rows], pa.int64()), pa.array([s for _, s, _ in rows], pa.int64()), pa.array([x.astype("<u4").tobytes() for _, _, x in rows], pa.binary())], ["file", "doc_id", "local", "ids"])

    bases = running_total(manifest, [], ["shard"], "ids", "base").select("name", "base")
    if not manifest.take(1):
        return spark.createDataFrame([], "doc_id long, start long, ids binary")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.sst").load(folder)
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInArrow(f, "file string, doc_id long, local long, ids binary")
    return rows.join(bases, F.col("file") == F.col("name")).select("doc_id", (F.col("local") + F.col("base")).alias("start"), "ids")
