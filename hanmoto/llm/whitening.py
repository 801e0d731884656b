"""Embedding whitening from an exact scatter matrix in residue numbers.

Vectors become whole numbers x = floor(SCALE * c) + SHIFT. Their scatter (the sum of x times x transposed) outgrows 53 and then 63 bits with
the number of vectors, so tasks work in residues: for each of several primes a task multiplies its block of residues with itself, exactly in
doubles since no sum of products reaches 2^53, and adds blocks up. Spark sums the tasks' matrices entry by entry; what comes back is
(dimensions + 1)^2 / 2 numbers for each prime, whatever the number of vectors. Chinese remaindering gives the scatter itself, as many
primes as the count and the largest entry ask for. The covariance n * scatter - S S' is centred exactly, as whole numbers, before it is
rounded to doubles once; eigh is taken twice, the second time of the covariance turned by the first one's vectors in extended precision, which
sharpens small eigenvalues.

Defined results: vectors that are null or hold null or non-finite entries are dropped, and so are those of another length than most (the longer
one of two that are equally frequent), which are no points of the same space; SCALE * c is held within 2^60; repeated rows and ids
count and come back each; components are as many as dimensions, COMPONENTS at most; a component without variance has
no ``whitened`` (null, as for a single vector) and no part in ``identity_error``, which is null if there is no other; ``explained`` is null if nothing
varies; a ``deviation`` beyond 2^63 is null and stands in ``deviation_digits``; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

SCALE, SHIFT, COMPONENTS = 1024.0, 100_000, 8
#: Bits of a prime; rows of a block, whose products of centred residues stay below 2^53; numbers converted at once.
BITS = 22
ROWS, NUMBERS = 1 << (53 - 2 * (BITS - 1)), 1 << 20
#: Matrices that reach the shuffle are at most so many for each core; a task adds up all it reads.
TASKS_A_CORE = 4


def primes(beyond: int) -> list[int]:
    """The largest primes of BITS bits whose product is larger than ``beyond``."""
    small = [p for p in range(3, 1 << (BITS // 2 + 1), 2) if all(p % q for q in range(3, int(p**0.5) + 1, 2))]
    out, product, p = [], 1, (1 << BITS) - 1
    while product <= beyond:
        if all(p % q for q in small):
            out.append(p)
            product *= p
        p -= 2
    return out


def whole_numbers(c: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(c * SCALE), -(2.0**60), 2.0**60).astype(np.int64) + SHIFT


def _vectors(batches: Iterator[pa.RecordBatch], d: int | None = None) -> Iterator[tuple[pa.Array, np.ndarray, int]]:
    """Keys and rows of whole numbers, for one length of vectors or for all (then with that length), in bounded blocks."""
    for batch in batches:
        lists = batch.column(1)
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        for size in [d] if d is not None else np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            step = max(1, NUMBERS // max(1, int(size)))
            for lo in range(0, len(at), step):
                rows = pa.array(at[lo : lo + step])
                x = lists.take(rows).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                yield batch.column(0).take(rows), whole_numbers(x).reshape(len(rows), int(size)), int(size)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[int, list[int]] = {}
    for _, x, d in _vectors(batches):
        s = seen.setdefault(d, [0, 0])
        s[0], s[1] = s[0] + len(x), max(s[1], int(np.abs(x).max(initial=0)))
    yield pa.record_batch([pa.array(list(seen), pa.int64()), pa.array([s[0] for s in seen.values()], pa.int64()), pa.array([s[1] for s in seen.values()], pa.int64())], ["d", "n", "largest"])


def residue_products(x: np.ndarray, p: int) -> np.ndarray:
    """The scatter of rows modulo p, with a column of ones behind them, so that it holds their sums too."""
    r = x % p
    r = np.concatenate([np.where(r > p // 2, r - p, r), np.ones((len(x), 1), np.int64)], 1).astype(np.float64)
    out = np.zeros((r.shape[1],) * 2, np.int64)
    for lo in range(0, len(r), ROWS):
        b = r[lo : lo + ROWS]
        out += (b.T @ b).astype(np.int64) % p
    return out % p


def _scatter(d: int, ps: list[int]):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(ps), d + 1, d + 1), np.int64)
        for _, x, _ in _vectors(batches, d):
            for k, p in enumerate(ps):
                total[k] = (total[k] + residue_products(x, p)) % p
        for k in range(len(ps)):
            yield pa.record_batch([pa.array([k] * (d + 1), pa.int32()), pa.array(range(d + 1), pa.int32()), pa.array([row[i:] for i, row in enumerate(total[k])], pa.list_(pa.int64()))], ["k", "i", "row"])

    return f


def chinese_remainder(residues: np.ndarray, ps: list[int]) -> np.ndarray:
    """Signed whole numbers from their residues, one layer a prime."""
    product = 1
    for p in ps:
        product *= p
    value = sum(layer.astype(object) * (product // p * pow(product // p, -1, p)) for layer, p in zip(residues, ps, strict=True)) % product
    return np.where(value > product // 2, value - product, value)


def exact_scatter(clean: DataFrame, d: int, n: int, largest: int) -> tuple[np.ndarray, list[int]]:
    """The scatter and the sums of all vectors, as whole numbers of any size."""
    ps = primes(2 * n * max(largest, 1) ** 2 + 1)
    few = clean.coalesce(TASKS_A_CORE * clean.sparkSession.sparkContext.defaultParallelism)
    sums = few.mapInArrow(_scatter(d, ps), "k int, i int, row array<long>").select("k", "i", F.posexplode("row").alias("j", "v")).groupBy("k", "i", "j").agg(F.sum("v").alias("v"))
    found = sums.toArrow()
    k, i, j, v = (found.column(c).to_numpy() for c in ("k", "i", "j", "v"))
    total = np.zeros((len(ps), d + 1, d + 1), np.int64)
    total[k, i, i + j] = total[k, i + j, i] = v % np.array(ps)[k]
    whole = chinese_remainder(total, ps)
    return whole[:d, :d], whole[:d, d].tolist()


def principal(scatter: np.ndarray, sums: list[int], n: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The largest eigenvalues of the covariance, their unit vectors as columns (largest entry positive), and the share of the trace that each explains."""
    s = np.array(sums, object)
    centred = n * scatter - np.outer(s, s)
    v = (centred / (n * n)).astype(np.float64)
    turn = np.linalg.eigh(v)[1]
    extended = turn.astype(np.longdouble)
    turned = (extended.T @ v.astype(np.longdouble) @ extended).astype(np.float64)
    e, again = np.linalg.eigh((turned + turned.T) / 2)
    u = turn @ again
    order = np.argsort(-e, kind="stable")[:count]
    e, u = e[order], u[:, order]
    u = u / np.linalg.norm(u, axis=0) * np.where(u[np.abs(u).argmax(0), np.arange(len(order))] < 0, -1.0, 1.0)
    trace = int(np.trace(centred)) / (n * n)
    e = np.where(e > len(v) * np.finfo(np.float64).eps * max(e.max(initial=0.0), 0.0), e, 0.0)
    return e, u, e / trace if trace else np.full(len(e), np.nan)


def deviations(y: np.ndarray, rest: np.ndarray, n: int) -> list[int]:
    """Sums of (n * y - rest)^2 by row, exactly."""
    reach = n * int(np.abs(y).max(initial=0)) + n
    if reach * reach * max(1, y.shape[1]) < 1 << 63:
        return ((n * y - rest.astype(np.int64)) ** 2).sum(1).tolist()
    return ((n * y.astype(object) - rest) ** 2).sum(1).tolist()


def _whiten(d: int, n: int, sums: list[int], e: np.ndarray, u: np.ndarray):
    mean = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], object)
    part = np.array([r / n for r in rest], np.float64)
    scale = np.where(e > 0, np.sqrt(e), np.nan)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, x, _ in _vectors(batches, d):
            y = x - mean
            w = (y.astype(np.float64) - part) @ u / scale
            far = deviations(y, rest, n)
            fits = [v < 1 << 63 for v in far]
            values = pa.array(w.ravel(), pa.float64(), from_pandas=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * w.shape[1], pa.int32()), values)
            digits = pa.array([None if ok else str(v) for v, ok in zip(far, fits, strict=True)], pa.string())
            yield pa.record_batch([keys, pa.array([v if ok else None for v, ok in zip(far, fits, strict=True)], pa.int64()), digits, lists], ["key", "deviation", "deviation_digits", "w"])

    return f


def identity_error(white: DataFrame, e: np.ndarray) -> float | None:
    """The largest absolute entry of the whitened vectors' covariance (centred first) minus the identity."""
    live = [i for i, x in enumerate(e) if x > 0]
    if not live:
        return None
    mean = white.agg(*[F.avg(F.get("w", i)).alias(f"m{i}") for i in live]).first()
    off = {i: F.get("w", i) - mean[f"m{i}"] for i in live}
    pairs = [(i, j) for i in live for j in live if i <= j]
    found = white.agg(*[F.avg(off[i] * off[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """A row for each remaining vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error, deviation_digits``."""
    spark = vectors.sparkSession
    own = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("c"))
    clean = own.filter(F.col("c").isNotNull() & F.forall("c", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    lengths = clean.mapInArrow(_measure, "d long, n long, largest long").groupBy("d").agg(F.sum("n").alias("n"), F.max("largest").alias("largest"))
    found = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    at = T.StructType([T.StructField("key", own.schema["key"].dataType), *T._parse_datatype_string("deviation long, deviation_digits string, w array<double>").fields])
    if found is None or not found["d"]:
        white, e, shares, n, error = spark.createDataFrame([], at), [], [], 0, None
    else:
        d, n = found["d"], found["n"]
        scatter, sums = exact_scatter(clean, d, n, found["largest"])
        e, u, shares = principal(scatter, sums, n, components)
        white = materialize(clean.mapInArrow(_whiten(d, n, sums, e, u), at), "whitened")
        error = identity_error(white, e)
    out = white.select("key", "deviation", "deviation_digits", F.posexplode("w").alias("_i", "whitened"))
    explained = F.get(F.array(*[F.lit(None if np.isnan(x) else float(x)).cast("double") for x in shares]).cast("array<double>"), F.col("_i"))
    return out.select(F.col("key").alias(key), (F.col("_i") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).cast("double").alias("identity_error"), "deviation_digits")
