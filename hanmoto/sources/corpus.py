"""Corpus sources and sinks: text files in Shift_JIS or UTF-8, packed archives, incremental packing.

A corpus is any DataFrame with ``label`` and ``content`` (bytes). The native archive is Parquet with the columns of ``ARCHIVE``; packed
files of the older binary layout are read and written too.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The setting that names the corpus folder for ``from_conf``.
ROOT = "spark.hanmoto.corpus.root"
ARCHIVE = "label string, mtime_ns long, source_hash binary, decoded_len long, payload_len long, payload binary"
# The packed layout's magic, version, flags and largest entry.
MAGIC, VERSION, ZSTD, UTF8, LARGEST = b"AOZC", 1, 1, 2, 256 << 20
_HEAD, _ENTRY = struct.Struct("<4sIII"), struct.Struct("<QIIq32sI")


def read_directory(spark: SparkSession, root: str, pattern: str = "*.txt") -> DataFrame:
    """``label`` (path below the root), ``mtime_ns``, ``content`` of all files with the ending, at any depth."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    base = root.split("://", 1)[-1].removeprefix("file:").rstrip("/")
    label = F.substring_index("path", f"{base}/", -1)
    return files.select(label.alias("label"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), "content")


def from_conf(spark: SparkSession) -> DataFrame | None:
    """The corpus under the configured root, none if the setting is absent."""
    root = spark.conf.get(ROOT, None)
    return read_directory(spark, root) if root else None


def from_items(spark: SparkSession, items: list[tuple[str, bytes]]) -> DataFrame:
    return spark.createDataFrame(items, "label string, content binary")


def read_vendored(spark: SparkSession, root: str, name: str = "input.sjis.txt") -> DataFrame:
    """One file of a fixed name in each card's folder; the label is the folder's name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root)
    return files.select(F.element_at(F.split("path", "/"), -2).alias("label"), "content")


#: What the codec makes of the single bytes A0 and FD to FF, which aren't Shift_JIS.
_BAD = re.compile("[\uf8f0-\uf8f3]")


@F.pandas_udf(T.StringType())
def decode_sjis(content: pd.Series) -> pd.Series:
    """Strict Shift_JIS as browsers read it; null on any bad byte."""

    def one(raw):
        try:
            text = None if raw is None else bytes(raw).decode("cp932")
        except UnicodeDecodeError:
            return None
        return None if text is None or _BAD.search(text) else text

    return content.map(one)


def decode(content, encoding: str = "auto"):
    """Text of bytes: ``sjis``, ``utf8`` (both strict, null on errors), or Shift_JIS and else UTF-8."""
    utf8 = F.try_validate_utf8(content.cast("string"))
    return {"sjis": decode_sjis(content), "utf8": utf8, "auto": F.coalesce(decode_sjis(content), utf8)}[encoding]


def has_bom(content):
    return F.substring(content, 1, 3) == F.lit(b"\xef\xbb\xbf")


def texts(corpus: DataFrame, encoding: str = "auto") -> DataFrame:
    """``label, source`` of what decodes, and null sources for what doesn't."""
    return corpus.select("label", decode(F.col("content"), encoding).alias("source"))


def archive_rows(corpus: DataFrame, utf8: bool = True) -> DataFrame:
    """``corpus`` (label, mtime_ns, content) in the archive's columns; bytes that don't decode stay as they are."""
    payload = F.coalesce(F.encode(decode_sjis(F.col("content")), "UTF-8"), F.col("content")) if utf8 else F.col("content")
    own = corpus.select("label", "mtime_ns", F.unhex(F.sha2("content", 256)).alias("source_hash"), payload.alias("payload"))
    size = F.octet_length("payload").cast("long")
    return own.select("label", "mtime_ns", "source_hash", size.alias("decoded_len"), size.alias("payload_len"), "payload")


def write_archive(rows: DataFrame, path: str, level: int = 19) -> None:
    rows.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).parquet(path)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """A lookup by label reads the row groups that may hold it."""
    return spark.read.schema(ARCHIVE).parquet(path)


def pack_plan(current: DataFrame, previous: DataFrame) -> DataFrame:
    """``label, action``: reuse where label, time and hash are as before, else encode; removed for labels that are gone.

    Both sides have ``label, mtime_ns, source_hash``; no payload is needed to decide.
    """
    old = previous.select("label", F.col("mtime_ns").alias("_t"), F.col("source_hash").alias("_h"))
    same = (F.col("mtime_ns") == F.col("_t")) & (F.col("source_hash") == F.col("_h"))
    kept = current.join(old, "label", "left").select("label", F.when(same, "reuse").otherwise("encode").alias("action"))
    gone = previous.join(current.select("label"), "label", "left_anti").select("label", F.lit("removed").alias("action"))
    return kept.unionByName(gone)


def pack(corpus: DataFrame, previous: DataFrame | None, utf8: bool = True) -> DataFrame:
    """The new archive's rows; what may be reused isn't decoded again."""
    if previous is None:
        return archive_rows(corpus, utf8)
    hashed = corpus.withColumn("source_hash", F.unhex(F.sha2("content", 256)))
    plan = pack_plan(hashed.select("label", "mtime_ns", "source_hash"), previous)
    fresh = archive_rows(corpus.join(plan.filter("action = 'encode'").select("label"), "label", "left_semi"), utf8)
    return previous.join(plan.filter("action = 'reuse'").select("label"), "label", "left_semi").unionByName(fresh)


# The packed binary layout


def pack_bytes(entries: list[tuple[str, bytes, int, bytes]], flags: int = ZSTD | UTF8, level: int = 19) -> bytes:
    """A packed file of (label, content, mtime_ns, 32-byte hash) entries."""
    payloads = [zstandard.ZstdCompressor(level=level).compress(c) if flags & ZSTD else c for _, c, _, _ in entries]
    at = _HEAD.size + sum(_ENTRY.size + len(label.encode()) for label, *_ in entries)
    index = []
    for (label, content, mtime, digest), payload in zip(entries, payloads, strict=True):
        name = label.encode()
        index.append(_ENTRY.pack(at, len(payload), len(content), mtime, digest, len(name)) + name)
        at += len(payload)
    return _HEAD.pack(MAGIC, VERSION, flags, len(entries)) + b"".join(index) + b"".join(payloads)


def unpack_bytes(data) -> Iterator[tuple[str, int, bytes, int, int, bytes]]:
    """label, mtime_ns, hash, decoded_len, payload_len, content of each entry; bad files raise."""
    magic, version, flags, count = _HEAD.unpack_from(data)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a packed corpus of version 1")
    at = _HEAD.size
    for _ in range(count):
        place, n, decoded, mtime, digest, length = _ENTRY.unpack_from(data, at)
        at += _ENTRY.size
        label = bytes(data[at : at + length]).decode()
        at += length
        if place + n > len(data) or decoded > LARGEST:
            raise ValueError(f"the entry {label} lies outside the file or is too large")
        raw = bytes(data[place : place + n])
        yield label, mtime, digest, decoded, n, zstandard.ZstdDecompressor().decompress(raw, max_output_size=decoded or 1) if flags & ZSTD else raw


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """Packed files in the archive's columns, content decompressed; a file is one row of its scan and must fit a task."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
        names = [x.split()[0] for x in ARCHIVE.split(", ")]
        for b in batches:
            for data in b.column(0):
                rows = []
                for r in unpack_bytes(memoryview(data.as_buffer())):
                    rows.append(r)
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(f, ARCHIVE)


# Sinks


def write_html(parsed: DataFrame, path: str, html: str = "html") -> None:
    """One text record per document; line ends inside are kept by the record separator NUL."""
    parsed.select(html).write.option("lineSep", "\0").text(path)


def format_check(df: DataFrame, source: str = "source") -> DataFrame:
    """Adds ``serialized`` and ``changed``: whether it differs from the source, one byte-order mark and CRLF line ends aside."""
    from ..operators.parse import parse

    found = parse(df, ["serialized"], source, "_p").withColumn("serialized", F.col("_p.serialized")).drop("_p")
    bare = F.replace(F.regexp_replace(source, "^\\x{FEFF}", ""), F.lit("\r\n"), F.lit("\n"))
    return found.withColumn("changed", ~F.col("serialized").eqNullSafe(bare))


def write_formatted(df: DataFrame, path: str, source: str = "source") -> DataFrame:
    """Writes the table in canonical form to a new path and gives it back as read from there, with ``changed``.

    The input is read while this writes, so it is never overwritten: a path that exists is an error. Null sources stay null and unchanged.
    """
    columns = [F.when(F.col(source).isNotNull(), F.col("serialized")).alias(c) if c == source else F.col(c) for c in df.columns]
    format_check(df, source).select(*columns, (F.col("changed") & F.col(source).isNotNull()).alias("changed")).write.mode("error").parquet(path)
    return df.sparkSession.read.parquet(path)


def synthetic(unit: str, n_bytes: int) -> str:
    """A unit repeated until the size is reached."""
    return unit * -(-n_bytes // len(unit.encode()))
