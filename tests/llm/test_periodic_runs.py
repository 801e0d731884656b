"""Runs against every period tried at every place, the number of comparisons, and the digest by hand."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hanmoto.llm import periodic_runs as P

from . import edge


def by_hand(t, fewest):
    n, out = len(t), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            s = i
            while i + p < n and t[i] == t[i + p]:
                i += 1
            length = i - s + p
            if i > s and length >= max(2 * p, fewest) and not any(p % q == 0 and b <= s and b + m >= s + length for b, m, q in out):
                out[(s, length, p)] = 1
            i += i == s
    return sorted(out, key=lambda r: (r[0], r[2]))


def texts(r, n, k):
    t = [r.randrange(k) for _ in range(n)]
    if r.random() < 0.4:
        w = [r.randrange(k) for _ in range(r.randint(1, 9))]
        t = (w * n)[:n]
        t[r.randrange(n)] = r.randrange(k)
    return t


@pytest.mark.parametrize("many", [P.MANY, 10])
def test_runs_match_every_period_tried(monkeypatch, many):
    monkeypatch.setattr(P, "MANY", many)
    r = random.Random(6)
    for _ in range(4000):
        t, fewest = texts(r, r.randint(1, 45), r.choice([1, 2, 2, 3, 6])), r.choice([1, 2, 6, 12])
        assert P.runs(t, fewest) == by_hand(t, fewest), (t, fewest)


class Counted(list):
    reads = 0

    def __getitem__(self, i):
        Counted.reads += 1
        return list.__getitem__(self, i)


def test_the_array_is_right_and_takes_linear_time():
    r, fib = random.Random(2), ([0], [0, 1])
    while len(fib[1]) < 12_000:
        fib = (fib[1], fib[1] + fib[0])
    for t in ([0] * 12_000, [0, 1] * 6000, fib[1][:12_000], [bin(i).count("1") & 1 for i in range(12_000)], [r.randrange(2) for _ in range(12_000)], list(range(12_000)), sum(([0] * i + [1] for i in range(150)), []), ([0] * 70 + [1]) * 170, [r.randrange(5) for _ in range(3000)] * 4):
        for order in (t, [-x for x in t]):
            Counted.reads = 0
            P.lyndon(Counted(order))
            assert Counted.reads <= 12 * len(t)
    for _ in range(300):
        t = texts(r, r.randint(1, 40), 3)
        nss, nlce = P.lyndon(t)
        for i in range(len(t)):
            j = next((j for j in range(i + 1, len(t)) if t[j:] < t[i:]), len(t))
            assert nss[i] == j and (j == len(t) or nlce[i] == next(k for k in range(len(t) + 1) if t[j + k : j + k + 1] != t[i + k : i + k + 1] or j + k == len(t)))


def digest_by_hand(i, text, plant):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    if plant and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    codes = {}
    found = by_hand([codes.setdefault(x, len(codes)) for x in w], 12)
    gone = {k for s, m, p in found for k in range(s + p, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (i, len(found), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4), sha("".join(f"{s},{m},{p}\n" for s, m, p in found)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_digest_by_hand(spark):
    rows = [q for q in edge.rows() if len(q[1] or "") < 5000]
    r = random.Random(9)
    for i in range(200, 400):
        words = [r.choice(["la", "le", "un", "deux", "été", "\x1f"]) for _ in range(r.randint(0, 60))]
        if i % 3 == 0:
            words[len(words) // 2 :] = (["x", "y", "z"][: i % 4] * 40)[: r.randint(0, 40)]
        rows.append((i, r.choice([" ", "\n", " \t"]).join(words), "en", "s", 0, *rows[0][5:]))
    docs = spark.createDataFrame(rows, edge.SCHEMA).repartition(3)
    for plant in (False, True):
        own = docs.withColumn("text", P.with_periods(F.col("text"), F.col("doc_id"))) if plant else docs
        got = Counter(tuple(x) for x in P.digest(P.find_runs(own)).collect())
        want = Counter(digest_by_hand(q[0], q[1], plant) for q in rows)
        assert got == want and sum(x[1] > 0 for x in want) > 30
    assert P.digest(P.find_runs(docs.limit(0))).isEmpty()


def test_long_texts_and_many_runs():
    text = " ".join(["ab"] * 300_000) + " " + " ".join(f"w{i % 77_777}" for i in range(250_000))
    found, left = P.find_and_collapse(text)
    assert found == [(0, 300_000, 1), (300_000, 250_000, 77_777)] and len(left.split()) == 1 + 77_777
