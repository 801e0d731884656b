"""One document of each group of exact and near copies, found by covering SimHash and MinHash and verified by shingles.

Candidates are distinct texts connected by fingerprints within CANDIDATE_RADIUS bits, in any of PRINTS independent fingerprints of two-word
shingles, or by one of BANDS equal bands of ROWS minima of their five-word shingles. Fingerprints join cheaply what differs in scattered
words; two texts of similarity s share no band with probability (1 - s^ROWS)^BANDS, wherever they differ, which is 3 in a million at 0.8 and
less above. Two texts of a candidate group are a link if the Jaccard similarity of their five-word shingles is SIMILAR or more. The
smallest key of each connected component of links stays.

The links of fingerprints come as spanning forests and are verified first. Groups that these don't connect are cut into blocks of BLOCK
texts (fewer of long ones), and every pair of blocks is compared whole, in one matrix product, so no link inside a group is missed. A pair of blocks is one row and
gives a spanning forest of its links; a group of n texts makes (n / BLOCK)^2 / 2 such rows.

Defined results: null and blank texts are equal texts if they are the same value, and alike (no shingles) otherwise; a null key
counts as larger than any; repeated rows are exact copies; other columns are kept; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, running_total, scratch
from .simhash import KEY, SEED, _mixed, components, expand, fingerprints, links, parts_for, shingle_hashes, squeeze

SIMILAR, SHINGLE = 0.8, 5
CANDIDATE_SHINGLE, CANDIDATE_RADIUS, PRINTS = 2, 4, 4
#: Bands of a text and minima in each.
BANDS, ROWS = 32, 5
#: Texts of a block, and bytes of packed shingles that make it full with fewer.
BLOCK, BLOCK_BYTES = 256, 4 << 20


def shingle_set(text: str | None) -> bytes:
    """Sorted distinct 32-bit hashes as packed differences."""
    parts = [h.astype(np.uint32) for h in shingle_hashes(text, SHINGLE)]
    values = np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint32)
    planes = np.diff(values, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes)


def read_set(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(4, -1).T).reshape(-1).view(np.uint32), dtype=np.uint32)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) and not len(b):
        return 1.0
    both = np.sort(np.concatenate([a, b]))
    common = np.count_nonzero(both[1:] == both[:-1])
    return common / (len(both) - common)


def band_keys(values: np.ndarray) -> np.ndarray:
    """One 64-bit key a band, of the least values that ROWS permutations give the set; sets without values share all keys."""
    r = np.random.default_rng(SEED)
    odd, add = (r.integers(0, 1 << 32, BANDS * ROWS, np.uint32)[:, None] for _ in range(2))
    odd, least = odd | np.uint32(1), np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(values), 4096):
        least = np.minimum(least, (values[None, lo : lo + 4096] * odd + add).min(1))
    key = np.zeros(BANDS, np.uint64)
    for m in least.reshape(BANDS, ROWS).T:
        key = _mixed((key + m) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    return key


@F.pandas_udf(T.StructType([T.StructField("bits", T.ArrayType(T.LongType())), T.StructField("shingles", T.BinaryType())]))
def _prints(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"bits": [fingerprints(t, CANDIDATE_SHINGLE, count=PRINTS) for t in texts], "shingles": [shingle_set(t) for t in texts]})


@F.pandas_udf(T.BooleanType())
def _similar(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaccard(read_set(x), read_set(y)) >= SIMILAR for x, y in zip(a, b, strict=True)], dtype=bool)


def common_counts(a: list[np.ndarray], b: list[np.ndarray], width: int = 1 << 13) -> np.ndarray:
    """How many values each set of a has in common with each of b; distinct values are taken ``width`` at a time."""
    owner = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    column = np.unique(np.concatenate([*a, *b]), return_inverse=True)[1]
    out = np.zeros((len(a), len(b)))
    for lo in range(0, int(column.max(initial=-1)) + 1, width):
        here = (column >= lo) & (column < lo + width)
        m = np.zeros((len(a) + len(b), width), np.float32)
        m[owner[here], column[here] - lo] = 1
        out += m[: len(a)] @ m[len(a) :].T
    return out


def _compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From pairs of blocks (lists of node, label, shingles) a spanning forest of the links between different labels."""
    for batch in batches:
        for i in range(batch.num_rows):
            x, y = (batch.column(c)[i].as_py() for c in (0, 1))
            sets = [[read_set(t["shingles"]) for t in side] for side in (x, y)]
            size = [np.array([len(v) for v in side]) for side in sets]
            common = common_counts(*sets)
            union = size[0][:, None] + size[1][None, :] - common
            similar = np.where(union > 0, common >= SIMILAR * union - 1e-9, True)
            parent = {t["label"]: t["label"] for t in (*x, *y)}

            def root(v: int, parent: dict[int, int] = parent) -> int:
                while parent[v] != v:
                    parent[v] = parent[parent[v]]
                    v = parent[v]
                return v

            out = []
            for p, q in zip(*np.nonzero(similar), strict=True):
                u, v = root(x[p]["label"]), root(y[q]["label"])
                if u != v:
                    parent[max(u, v)] = min(u, v)
                    out.append((x[p]["node"], y[q]["node"]))
            yield pa.record_batch([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())], ["a", "b"])


def _pack_bands(parts: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, label = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            keys = b.column(2).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            rows = np.empty(len(keys), KEY)
            rows["table"], rows["bits"] = np.tile(np.arange(BANDS, dtype=np.uint64), len(node)), keys
            rows["node"], rows["label"] = np.repeat(node, BANDS), np.repeat(label, BANDS)
            part = (_mixed(rows["bits"] + rows["table"]) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            rows, part = rows[order], part[order]
            edges = np.flatnonzero(np.diff(part, prepend=-1))
            blobs = [squeeze(rows[i:j]) for i, j in zip(edges, [*edges[1:], len(rows)], strict=True)]
            yield pa.record_batch([pa.array(part[edges]), pa.array(blobs, pa.binary())], ["part", "rows"])

    return f


def _band_links(group: pa.Table) -> pa.Table:
    """Every member of a bucket with the first one; of the links between the same labels one is enough."""
    rows = np.concatenate([expand(x) for x in group.column("rows").to_pylist()])
    rows = rows[np.lexsort((rows["node"], rows["bits"], rows["table"]))]
    new = np.r_[True, (rows["bits"][1:] != rows["bits"][:-1]) | (rows["table"][1:] != rows["table"][:-1])]
    first = rows[np.flatnonzero(new)[np.cumsum(new) - 1]]
    pairs = np.sort(np.stack([first["label"], rows["label"]], 1), axis=1)
    keep = np.flatnonzero(pairs[:, 0] != pairs[:, 1])
    keep = keep[np.unique(pairs[keep], axis=0, return_index=True)[1]]
    return pa.table({"a": first["node"][keep], "b": rows["node"][keep]})


def _all_band_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = [band_keys(read_set(x)).view(np.int64) for x in b.column(1).to_pylist()]
        yield pa.record_batch([b.column(0), pa.array(keys, pa.list_(pa.int64()))], ["node", "bands"])


def band_links(prints: DataFrame, labels: DataFrame) -> DataFrame:
    """Links ``a, b`` between texts of different labels that share a band; those of the same label are connected already."""
    parts = parts_for(prints.count() * BANDS // 31, 4, prints.sparkSession)  # as many keys as one fingerprint of radius 4 has
    keys = prints.select("node", "shingles").mapInArrow(_all_band_keys, "node long, bands array<long>")
    met = keys.join(labels, "node").select("node", "label", "bands").mapInArrow(_pack_bands(parts), "part long, rows binary")
    return met.groupBy("part").applyInArrow(_band_links, "a long, b long").distinct()


def verified(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """Those of ``a, b`` that are similar. The smaller side's shingles travel with each pair, once."""
    left = pairs.join(prints.select(F.col("node").alias("a"), F.col("shingles").alias("_a")), "a")
    both = left.join(prints.select(F.col("node").alias("b"), F.col("shingles").alias("_b")), "b")
    return materialize(both.filter(_similar("_a", "_b")).select("a", "b"), "links")


def _with_labels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    labels = components(links).select(F.col("node").alias("_n"), "label")
    return materialize(nodes.join(labels, F.col("node") == F.col("_n"), "left").select("node", F.coalesce("label", "node").alias("label")), "labels")


def block_links(prints: DataFrame, labels: DataFrame, candidates: DataFrame) -> DataFrame:
    """All links (as spanning forests) inside candidate groups that hold more than one label."""
    groups_of = candidates.select("node", F.col("label").alias("group")).join(labels, "node")
    open_groups = groups_of.groupBy("group").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("group")
    weight = (1 + F.floor(F.octet_length("shingles") / (BLOCK_BYTES // BLOCK))).alias("_weight")
    members = materialize(groups_of.join(open_groups, "group").join(prints.select("node", weight), "node"), "members")
    numbered = running_total(members, ["group"], ["node"], "_weight", "i").select("group", "node", "label", F.floor(F.col("i") / BLOCK).cast("int").alias("block"))
    texts = numbered.join(prints.select("node", "shingles"), "node").groupBy("group", "block").agg(F.collect_list(F.struct("node", "label", "shingles")).alias("texts"))
    blocks = materialize(texts, "blocks")
    last = blocks.groupBy("group").agg(F.max("block").alias("n"))
    each = last.select("group", F.explode(F.sequence(F.lit(0), "n")).alias("p"), "n").select("group", "p", F.explode(F.sequence("p", "n")).alias("q"))
    x, y = (blocks.select("group", F.col("block").alias(c), F.col("texts").alias(f"_{c}")) for c in "pq")
    met = each.join(x, ["group", "p"]).join(y, ["group", "q"]).select("_p", "_q")
    return materialize(met.mapInArrow(_compare_blocks, "a long, b long"), "links")


def groups(prints: DataFrame, radius: int = CANDIDATE_RADIUS) -> DataFrame:
    """``node, label`` from a written table of ``node, bits, shingles``."""
    table = materialize(prints.select("node", F.posexplode("bits").alias("kind", "bits")), "kinds")
    # the first fingerprint connects most of a crowded group, so that the others add few links
    first = materialize(links(table.filter("kind = 0").select("bits", "node"), radius), "near")
    stars = _with_labels(prints.select("node"), first)
    more = materialize(links(table.filter("kind > 0").join(stars, "node"), radius), "near")
    both = components(stars.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more)).withColumnRenamed("node", "_n")
    near = materialize(stars.select("node").join(both, F.col("node") == F.col("_n"), "left").select("node", F.coalesce("label", "node").alias("label")), "labels")
    bands = materialize(band_links(prints, near), "near")
    candidates = components(near.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(bands))
    linked = verified(first.unionByName(more).unionByName(bands), prints)
    labels = _with_labels(prints.select("node"), linked)
    return _with_labels(prints.select("node"), linked.unionByName(block_links(prints, labels, candidates)))


def drop_near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents that stay, with their own columns. Besides packed keys and shingles, texts are shuffled once, at the end."""
    same = [F.xxhash64(F.col(text)), F.xxhash64(F.lit(1), F.col(text)), F.col(text).isNull()]  # a text after 1 is hashed from another seed, not from the first hash
    own = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(text).alias("_text"), F.col(key).alias("_key"), *[c.alias(f"_h{i}") for i, c in enumerate(same)])
    hashes = ["_h0", "_h1", "_h2"]
    first = F.min(F.struct(F.col("_key").isNull().alias("no"), F.col("_key").alias("key")))
    all_prints = own.select("_key", *hashes, _prints("_text").alias("p")).select("_key", *hashes, "p.*")
    with scratch(docs.sparkSession) as keep:
        distinct = materialize(all_prints.groupBy(*hashes).agg(first.alias("least"), F.first(F.struct("bits", "shingles")).alias("p")).select(*hashes, "least", "p.*", F.monotonically_increasing_id().alias("node")), "distinct")
        labels = groups(distinct.select("node", "bits", "shingles"))
        ranked = distinct.select("node", "least", *hashes).join(labels, "node")
        best = ranked.groupBy("label").agg(F.min(F.struct("least", "node")).alias("best")).select(F.col("best.node").alias("node"))
        stay = keep(ranked.join(best, "node").select(F.col("least.key").alias("_k"), *[F.col(h).alias(f"{h}_") for h in hashes]), "stay")
    met = own.join(stay, (F.col("_h0") == F.col("_h0_")) & (F.col("_h1") == F.col("_h1_")) & (F.col("_h2") == F.col("_h2_")) & F.col("_key").eqNullSafe(F.col("_k")))
    return met.dropDuplicates(["_key", *hashes]).select("_doc.*")
