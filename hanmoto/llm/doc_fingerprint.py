"""Document fingerprints from prefix polynomial hashes.

A fingerprint holds the hash of the whole text, its length, the prefix hashes at up to MARKS evenly spaced places (counted from the front,
and of the rest of the text from the back), and a sketch: the smallest span hashes over all spans of a fixed length. Short texts add a sketch of
shorter spans. Places are multiples of a power of two, so that texts of different lengths have places in common.

Likeness is the common share of two texts (Dice). Their longest common extensions from the front and from the back are found by binary search
over the prefix hashes, to within half a space (a 32nd of the longer text), and the share of common spans is estimated from the sketches (to
within about 0.06). Where the two agree within AGREE, the extensions decide; where the sketches say more, the texts have more in common
than their ends.

Defined results: a null text is empty; two empty texts are alike (1), an empty and another aren't (0); texts shorter than a span have one
span; very long texts are hashed in pieces of bounded size; repeated ids are ordered by text hash; null ids come last in descending
order; an only document is its own next one; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import range_of, tasks
from .prefix_hash import BASES, PRIME, PrefixHash, mix, reduce

#: Span lengths in bytes; texts up to SHORT bytes have the second sketch too. Hashes in a sketch; bytes hashed at once.
SPAN, SHORT_SPAN, SHORT, KEPT, CHUNK = 24, 4, 256, 64, 1 << 20
MARKS, AGREE = 32, 0.15
_NONE = np.empty(0, np.uint64)


def _smallest(hashes: np.ndarray, n: int) -> np.ndarray:
    few = 4 * n
    if len(hashes) > few:
        part = np.unique(np.partition(hashes, few)[:few])
        if len(part) >= n:
            return part[:n]
    return np.unique(hashes)[:n]


def _sketch(hashed: list[tuple[PrefixHash, int]], k: int, total: int) -> np.ndarray:
    """``hashed``: pieces that overlap by SPAN - 1 bytes, with the number of starts that each owns."""
    if not total:
        return _NONE
    if total < k:
        h = hashed[0][0].span(np.array([0]), np.array([total]))
        return mix(h) >> np.uint64(32)
    kept = _NONE
    for p, own in hashed:
        kept = _smallest(np.concatenate([kept, mix(p.windows(k)[:own]) >> np.uint64(32)]), KEPT)
    return kept


def space(n: int) -> int:
    """Between the places of a text of n bytes, of which there are at most MARKS."""
    return 1 << max(0, (max(n, 1) - 1).bit_length() - MARKS.bit_length() + 1)


def _hex(x: np.ndarray) -> str:
    return x.astype(">u4").tobytes().hex()


def fingerprint(text: str | bytes) -> str:
    """``whole.length.front.back.sketch.short-sketch``, in hexadecimal."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text, np.uint8)
    n = len(raw)
    whole, kept, short = [0, 0], _NONE, _NONE
    front = space(n) * np.arange(1, n // space(n) + 1)
    places = np.concatenate([front, n - front])
    sums = np.zeros((2, len(places)), np.uint64)  # prefix hashes there
    for at in range(0, max(n, 1), CHUNK):
        p = PrefixHash(raw[at : at + CHUNK + SPAN - 1])
        own = min(CHUNK, n - at)
        here = np.flatnonzero((places > at) & (places <= at + own))
        for r in range(2):
            moved = np.uint64(pow(BASES[r], at, PRIME))
            sums[r, here] = reduce(reduce(p.sums[r][places[here] - at] * moved) + np.uint64(whole[r]))
            whole[r] = (whole[r] + int(p.sums[r][own]) * int(moved)) % PRIME
        if n < SPAN:
            kept = _sketch([(p, own)], SPAN, n)
        else:
            kept = _smallest(np.concatenate([kept, mix(p.windows(SPAN)[:own]) >> np.uint64(32)]), KEPT)
        if n <= SHORT:
            short = _sketch([(p, own)], SHORT_SPAN, n)
    name = (whole[0] << 31 | whole[1]) ^ n << 1
    k = len(front)
    marks = mix(sums[0, :k] << np.uint64(31) | sums[1, :k]) >> np.uint64(32)
    rest = []  # spans from a place to the end, hashed as if they began the text
    for r in range(2):
        first, by = pow(BASES[r], -n, PRIME), pow(BASES[r], space(n), PRIME)
        back = np.array([first := first * by % PRIME for _ in range(k)], np.uint64)
        rest.append(reduce(reduce(np.uint64(whole[r] + PRIME) - sums[r, k:]) * back))
    ends = mix(rest[0] << np.uint64(31) | rest[1]) >> np.uint64(32)
    return f"{name & (1 << 64) - 1:016x}.{n:x}.{_hex(marks)}.{_hex(ends)}.{_hex(kept)}.{_hex(short)}"


def _numbers(x: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(x), ">u4").astype(np.int64)


def extension(a: str, b: str, n: int, m: int) -> int:
    """How far two texts of n and m bytes are equal from the side that their marks are counted from, by binary search."""
    step = max(space(n), space(m))
    low, high = 0, min(n, m) // step
    cell = lambda x, own, k: x[8 * (k * step // own - 1) :][:8]
    while low < high:
        mid = (low + high + 1) // 2
        if cell(a, space(n), mid) == cell(b, space(m), mid):
            low = mid
        else:
            high = mid - 1
    return min(n, m, low * step + step // 2) if low else 0


def ends_in_common(x: list[str], y: list[str]) -> float:
    """The share (Dice) of the common extensions from the front and from the back."""
    n, m = int(x[1], 16), int(y[1], 16)
    return 2 * min(n, m, extension(x[2], y[2], n, m) + extension(x[3], y[3], n, m)) / max(1, n + m)


def spans_in_common(x: list[str], y: list[str]) -> float:
    """The share (Dice) of common spans, from the sketches."""
    i = 5 if x[5] and y[5] else 4
    p, q = _numbers(x[i]), _numbers(y[i])
    if not len(p) or not len(q):
        return 0.0
    both = np.sort(np.concatenate([p, q]))
    twice = both[:-1] == both[1:]
    distinct = np.flatnonzero(np.r_[True, ~twice])
    # a union's smallest KEPT values are known from both sketches
    limit = min(KEPT, len(distinct))
    edge = both[distinct[limit - 1]]
    share = np.count_nonzero(twice & (both[:-1] <= edge)) / limit
    return 2 * share / (1 + share)


def likeness(a: str, b: str) -> float:
    """From 0 to 1 (the same text)."""
    if a == b:
        return 1.0
    x, y = a.split("."), b.split(".")
    ends, spans = ends_in_common(x, y), spans_in_common(x, y)
    return ends if spans < ends + AGREE and ends > 0 else spans


def edited(text: str, following: str) -> str:
    """The last half of ``text`` replaced by as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


OUT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_next(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: its fingerprint, its edited text's, and their likeness; the next document is the next lower id, after the last the first.

    Texts are shuffled once, to ranges of ids; the first document of each range also goes, as a guest, to the end of the range before.
    """
    ranged = range_of(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_key", "_range")
    heads = sorted(ranged.groupBy("_range").agg(F.max("_key").alias("head")).collect(), key=lambda r: -r["_range"])  # MAX_RANGES rows at most
    if not heads:
        return docs.select(key).mapInArrow(lambda batches: iter(()), f"`{key}` {docs.schema[key].dataType.simpleString()}, {OUT}")
    guests = docs.sparkSession.createDataFrame([(r["_range"], r["head"], heads[i - 1]["_range"]) for i, r in enumerate(heads)], "_of int, _head long, _to int")
    met = ranged.join(F.broadcast(guests), (F.col("_range") == F.col("_of")) & F.col("_key").eqNullSafe(F.col("_head")), "left")
    places = F.array(F.struct(F.col("_range").alias("at"), F.lit(False).alias("guest")), F.struct(F.col("_to").alias("at"), F.lit(True).alias("guest")))
    both = met.select("_key", "_text", F.explode(F.filter(places, lambda p: p["at"].isNotNull())).alias("p"))
    order = [F.col("p.at"), F.col("p.guest"), F.col("_key").desc_nulls_last(), F.xxhash64("_text")]
    placed = both.repartition(tasks(docs.sparkSession), F.col("p.at")).sortWithinPartitions(*order).select(F.col("p.at").alias("at"), F.col("p.guest").alias("guest"), "_key", "_text")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # range, key, text, fingerprint of a row whose next one is still to come
        for b in batches:
            keys, out = [], []
            for at, guest, k, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                t = t or ""
                own = fingerprint(t)
                if before and before[0] == at:
                    mine = edited(before[2], t).encode("utf-8", "surrogatepass")
                    other = fingerprint(mine)
                    keys.append(before[1])
                    out.append((len(before[2]), hashlib.sha256(mine).hexdigest(), before[3], other, likeness(before[3], other), likeness(before[3], own)))
                before = None if guest else (at, k, t, own)
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.record_batch([pa.array(keys, b.schema.field(2).type), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [key, *(x.split()[0] for x in OUT.split(", "))])

    return placed.mapInArrow(f, f"`{key}` {docs.schema[key].dataType.simpleString()}, {OUT}")
