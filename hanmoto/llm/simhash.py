"""SimHash fingerprints linked by covering locality-sensitive hashing.

Each of the 64 bits gets a nonzero vector over GF(2) of radius + 1 components. For every nonzero vector u there is a table whose mask
holds the bits with an odd product with u. The vectors of at most ``radius`` differing bits are all orthogonal to some u, so two
fingerprints within the radius agree under that mask: no link is missed.

Keys travel packed: a map task sends each bucket part one binary value. A bucket gives a spanning forest of its links, not all pairs.

Defined results: a null or blank text has no shingles and fingerprint zero, linked like any other; texts with fewer words than a
shingle have one; repeated rows share everything; a null key is a document of its own (its component may be named null);
other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from itertools import starmap

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch, tasks

WORDS_PER_SHINGLE, RADIUS, SEED = 3, 3, 42
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of text hashed at once, bytes of keys in a bucket part, members of a bucket compared in one go.
CHUNK, PART, DENSE = 1 << 20, 8 << 20, 4096
KEY = np.dtype([("table", "<u8"), ("bits", "<u8"), ("node", "<i8"), ("label", "<i8")])
#: Bytes that a key takes in a packed part, about.
PACKED = 14


def shingle_hashes(text: str | None, k: int, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of every k-word shingle, repeats included, in pieces of bounded size; letters A-Z are lower-cased."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    digest = partial(xxhash.xxh64_intdigest, seed=seed)
    tail: list[bytes] = []
    at, any_yet = 0, False
    while at < len(raw) or not at:
        end = at + CHUNK
        if end < len(raw):
            found = _SPACE.search(raw, end)
            end = found.start() if found else len(raw)
        words = tail + raw[at:end].split()
        at = max(end, 1)
        if len(words) >= k:
            joined = b" ".join(words)
            stop = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            start = np.concatenate(([0], stop[:-1] + 1))
            n = len(words) - k + 1
            cut = map(joined.__getitem__, starmap(slice, zip(start[:n].tolist(), stop[k - 1 :].tolist(), strict=True)))
            yield np.fromiter(map(digest, cut), np.uint64, n)
            any_yet = True
            tail = words[n:]
        else:
            tail = words
    if not any_yet and tail:
        yield np.array([digest(b" ".join(tail))], np.uint64)


def fingerprints(text: str | None, k: int, seed: int = SEED, count: int = 1) -> list[int]:
    """The 64 bits as a signed integer; a bit is 1 if it is set in over half of the hashes. More than one come from other mixtures of the hashes."""
    total, ones = 0, np.zeros((count, 64), np.int64)
    for h in shingle_hashes(text, k, seed):
        total += len(h)
        for i in range(count):
            own = np.ascontiguousarray(h if i == 0 else _mixed(h * np.uint64(2 * i + 1) + np.uint64(i)))
            ones[i] += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > total, axis=1, bitorder="little").view("<i8")[:, 0].tolist()


def fingerprint(text: str | None, k: int, seed: int = SEED) -> int:
    return fingerprints(text, k, seed)[0]


def fingerprint_column(text: Column, k: int = WORDS_PER_SHINGLE) -> Column:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, k) for t in texts], dtype="int64")

    return of(text)


def masks(radius: int) -> np.ndarray:
    """The 2^(radius+1) - 1 covering masks over 64 bits."""
    count = (1 << (radius + 1)) - 1
    vector = [1 + i % count for i in range(64)]
    return np.array([sum(1 << i for i in range(64) if (u & vector[i]).bit_count() % 2) for u in range(1, count + 1)], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def squeeze(rows: np.ndarray) -> bytes:
    """Keys by column and by byte, compressed."""
    planes = b"".join(np.ascontiguousarray(rows[c]).view(np.uint8).reshape(-1, 8).T.tobytes() for c in KEY.names)
    return zstandard.ZstdCompressor(level=1).compress(planes)


def expand(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(len(KEY.names), 8, -1)
    rows = np.empty(raw.shape[2], KEY)
    for i, c in enumerate(KEY.names):
        rows[c] = np.ascontiguousarray(raw[i].T).reshape(-1).view(KEY[c])
    return rows


def _pack(radius: int, parts: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = masks(radius)
        for b in batches:
            bits = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            node, label, kind = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            for lo in range(0, len(bits), 4000):
                x, v, w, first = bits[lo : lo + 4000], node[lo : lo + 4000], label[lo : lo + 4000], kind[lo : lo + 4000].astype(np.uint64) * np.uint64(len(table))
                rows = np.empty(len(x) * len(table), KEY)
                part = np.empty(len(rows), np.int64)
                for u, m in enumerate(table):
                    s = slice(u * len(x), (u + 1) * len(x))
                    rows["table"][s], rows["bits"][s], rows["node"][s], rows["label"][s] = first + np.uint64(u), x, v, w
                    part[s] = _mixed((x & m) + first + np.uint64(u)) % np.uint64(parts)
                order = np.argsort(part, kind="stable")
                rows, part = rows[order], part[order]
                edges = np.flatnonzero(np.diff(part, prepend=-1))
                blobs = [squeeze(rows[i:j]) for i, j in zip(edges, [*edges[1:], len(rows)], strict=True)]
                yield pa.record_batch([pa.array(part[edges]), pa.array(blobs, pa.binary())], ["part", "rows"])

    return f


def spanning(bits: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (parent, child) of a spanning forest of all links within the radius; each member is compared once with those still unreached."""
    rest = np.arange(len(bits))
    parents, children = [], []
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            new_front = []
            for i in range(0, len(front), 256):
                f = front[i : i + 256]
                near = np.bitwise_count(bits[f][:, None] ^ bits[rest][None, :]) <= radius
                hit = near.any(0)
                if hit.any():
                    parents.append(f[near[:, hit].argmax(0)])
                    children.append(rest[hit])
                    new_front.append(rest[hit])
                    rest = rest[~hit]
            front = np.concatenate(new_front) if new_front else front[:0]
    none = np.empty(0, np.int64)
    return (np.concatenate(parents), np.concatenate(children)) if parents else (none, none)


def _forest(bits: np.ndarray, radius: int, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``spanning``; a crowded bucket is cut by equal blocks of its free bits, of which radius + 1 leave one without difference."""
    if len(bits) <= DENSE or len(free) <= 2 * (radius + 1):
        return spanning(bits, radius)
    parents, children = [], []
    for block in np.array_split(free, radius + 1):
        key = bits & np.bitwise_or.reduce(np.uint64(1) << block.astype(np.uint64))
        order = np.argsort(key, kind="stable")
        edges = np.flatnonzero(np.diff(key[order], prepend=~key[order[:1]]))
        for i, j in zip(edges, [*edges[1:], len(order)], strict=True):
            if j - i > 1:
                a, b = _forest(bits[order[i:j]], radius, np.setdiff1d(free, block))
                parents.append(order[i:j][a])
                children.append(order[i:j][b])
    none = np.empty(0, np.int64)
    return (np.concatenate(parents), np.concatenate(children)) if parents else (none, none)


def mask_of(table, radius: int) -> np.ndarray:
    """Tables are numbered through all kinds of fingerprints."""
    m = masks(radius)
    return m[np.asarray(table).astype(np.int64) % len(m)]


def sorted_buckets(blobs: pa.ChunkedArray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The part's keys sorted by table and bucket, and the first and last row of each bucket that holds more than one."""
    rows = np.concatenate([expand(x) for x in blobs.to_pylist()])
    key = rows["bits"] & mask_of(rows["table"], radius)
    order = np.lexsort((rows["node"], key, rows["table"]))
    rows, key = rows[order], key[order]
    first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (rows["table"][1:] != rows["table"][:-1])])
    last = np.r_[first[1:], len(rows)]
    many = last - first > 1
    return rows, first[many], last[many]


def _bucket_links(radius: int):
    def f(group: pa.Table) -> pa.Table:
        rows, first, last = sorted_buckets(group.column("rows"), radius)
        bits, node = rows["bits"], rows["node"]
        twos = last - first == 2
        a, b = first[twos], first[twos] + 1
        close = np.bitwise_count(bits[a] ^ bits[b]) <= radius
        left, right = [a[close]], [b[close]]
        for i, j in zip(first[~twos], last[~twos], strict=True):
            if (rows["label"][i:j] == rows["label"][i]).all():
                continue
            m = int(mask_of(rows["table"][i], radius))
            free = np.array([k for k in range(64) if not m >> k & 1])
            p, c = _forest(bits[i:j], radius, free)
            left.append(i + p)
            right.append(i + c)
        x, y = np.concatenate(left), np.concatenate(right)
        pairs = np.sort(np.stack([rows["label"][x], rows["label"][y]], 1), axis=1)
        keep = np.flatnonzero(pairs[:, 0] != pairs[:, 1])
        keep = keep[np.unique(pairs[keep], axis=0, return_index=True)[1]]
        return pa.table({"a": node[x[keep]], "b": node[y[keep]]})

    return f


def parts_for(nodes: int, radius: int, spark) -> int:
    return max(tasks(spark), -(-nodes * ((2 << radius) - 1) * PACKED // PART))


def packed(nodes: DataFrame, radius: int) -> DataFrame:
    """``part, rows`` of a written table of ``bits, node`` and, where they matter, ``label`` and the fingerprint's ``kind``."""
    label = F.col("label") if "label" in nodes.columns else F.col("node")
    kind = F.col("kind") if "kind" in nodes.columns else F.lit(0)
    return nodes.select("bits", "node", label.alias("label"), kind.cast("int").alias("kind")).mapInArrow(_pack(radius, parts_for(nodes.count(), radius, nodes.sparkSession)), "part long, rows binary")


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``a, b`` (distinct) whose connected components are those of all pairs within the radius, given that labels are connected already."""
    return packed(nodes, radius).groupBy("part").applyInArrow(_bucket_links(radius), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, label``: the smallest node of its component, for every node that has an edge.

    Alternates two star operations until nothing changes; each is a sum by node and a join, so a node with most edges
    is pre-aggregated and its join partition is split. Every round is written to the shared folder.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b")
        large = large.distinct()
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("u"))
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).filter("a > b").distinct()
        now = materialize(small, "edges")
        one = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if (one["n"], one["h"]) == mark:
            break
        mark = (one["n"], one["h"])
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def near_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = WORDS_PER_SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per document: key, ``bits`` (the fingerprint) and ``component_id``, the smallest key that is reachable by links."""
    with scratch(docs.sparkSession) as keep:
        prints = keep(docs.select(key, fingerprint_column(F.col(text), k).alias("bits")), "prints")
        each = materialize(prints.groupBy("bits").agg(F.min(key).alias("least")), "nodes")
        labels = components(links(each.select("bits", F.col("bits").alias("node")), radius))
        named = each.join(labels, F.col("bits") == F.col("node"), "left").select("bits", "least", F.coalesce("label", "bits").alias("label"))
        names = named.groupBy("label").agg(F.min("least").alias("component_id"))
        of = keep(named.join(names, "label").select(F.col("bits").alias("_bits"), "component_id"), "named")
    return prints.join(of, F.col("bits") == F.col("_bits")).select(key, "bits", "component_id")
