"""Whitening against whole numbers of Python and a plain covariance, and on awkward tables."""

import math

import numpy as np
import pytest

from hanmoto.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, component string, w string, n string, key string, c string"


def table(spark, vectors, parts=3):
    return spark.createDataFrame([(i, v, 1, "x", "y", "z", "k", "c") for i, v in vectors], SCHEMA).repartition(parts)


def by_hand(vectors):
    """Ids, whole numbers, and sums of squared deviations by Python's integers, dropped rows left out."""
    good = [(i, v) for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in good]
    n = len(x)
    sums = [sum(col) for col in zip(*x)]
    return [i for i, _ in good], x, [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x], sums


@pytest.mark.parametrize("spread", [1.0, 30.0])
def test_whitening_matches_a_plain_covariance(spark, spread):
    r = np.random.default_rng(4)
    turn = np.linalg.qr(r.normal(size=(12, 12)))[0]
    vectors = [(i, [float(c) for c in v]) for i, v in enumerate((r.normal(size=(900, 12)) * np.linspace(3, 0.5, 12) * spread) @ turn)]
    vectors += [(5, vectors[5][1]), (None, vectors[9][1]), (2000, None), (2001, [None, *vectors[0][1][1:]]), (2002, [float("nan"), *vectors[0][1][1:]]), (2003, [float("-inf"), *vectors[0][1][1:]]), (2004, [1.0, 2.0]), (2005, [])]
    ids, x, far, _ = by_hand([v for v in vectors if v[1] is None or len(v[1]) == 12])
    got = W.whiten(table(spark, vectors)).toPandas()
    assert len(got) == len(x) * 8 and set(got.n) == {len(x)} and sorted(got.component.unique()) == list(range(1, 9))
    first = got[got.component == 1]
    assert sorted(zip(first.vec_id.fillna(-1), first.deviation)) == sorted((-1 if i is None else i, d) for i, d in zip(ids, far))
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    z = np.array(x, float) - np.array(x, float).mean(0)
    v = z.T @ z / len(z)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:8], u[:, ::-1][:, :8]
    assert np.allclose(got.groupby("component").explained.first(), e / np.trace(v), rtol=1e-9)
    own = got[got.vec_id == 17].sort_values("component").whitened.to_numpy()
    assert np.allclose(np.abs(own), np.abs(z[17] @ u / np.sqrt(e)), atol=1e-6)


def test_scatter_is_exact_beyond_64_bits(spark):
    r = np.random.default_rng(8)
    vectors = [(i, [float(c) for c in v]) for i, v in enumerate(r.normal(size=(300, 5)) * 1e13)]
    ids, x, far, sums = by_hand(vectors)
    scatter, got_sums = W.exact_scatter(spark.createDataFrame([(i, [float(np.float32(c)) for c in v]) for i, v in vectors], "key long, c array<double>"), 5, 300, max(abs(a) for row in x for a in row))
    assert got_sums == sums
    assert scatter.tolist() == [[sum(row[i] * row[j] for row in x) for j in range(5)] for i in range(5)]
    got = W.whiten(table(spark, vectors)).filter("component = 1").collect()
    assert all(q.deviation is None for q in got) and {q.vec_id: int(q.deviation_digits) for q in got} == dict(zip(ids, far))


def test_residues_are_enough_for_any_count():
    ps = W.primes(2 * 10**12 * (1 << 61) ** 2)
    assert len(set(ps)) == len(ps) and all(p < 1 << W.BITS and all(p % q for q in range(2, 2100)) for p in ps) and W.ROWS * (1 << (W.BITS - 1)) ** 2 <= 1 << 53
    values = [0, -1, 10**12 * (1 << 122), -(10**12) * (1 << 122), 12345678901234567890]
    layers = np.array([[[v % p for v in values]] for p in ps], np.int64)
    assert W.chinese_remainder(layers, ps).tolist() == [values]


def test_awkward_tables(spark):
    schema = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_digits"]
    empty = W.whiten(table(spark, [(1, None), (2, [float("nan")])]))
    assert empty.columns == schema and empty.isEmpty() and W.whiten(table(spark, [(1, [1.0])]).limit(0)).isEmpty() and W.whiten(table(spark, [(1, [])])).isEmpty()
    one = W.whiten(table(spark, [(7, [1.0, 2.0])])).collect()
    assert [(q.vec_id, q.component, q.n, q.deviation, q.whitened, q.explained, q.identity_error) for q in sorted(one, key=lambda q: q.component)] == [(7, c, 1, 0, None, None, None) for c in (1, 2)]
    flat = W.whiten(table(spark, [(i, [float(i), 3.0, float(2 * i)]) for i in range(40)])).toPandas()
    assert flat[flat.component == 1].whitened.notna().all() and flat[flat.component > 1].whitened.isna().all() and flat.identity_error[0] < 1e-9
    huge = W.whiten(table(spark, [(1, [3e38, 1.0]), (2, [-3e38, 1.0]), (3, [0.0, 2.0])])).toPandas()
    assert huge[huge.component == 1].whitened.notna().all()
