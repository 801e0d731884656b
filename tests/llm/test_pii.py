"""Base patterns against plain expressions, the network against slow forms of itself, spans at window edges, and data written in other ways."""

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest

from hanmoto.llm import pii as P

from . import edge

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_by_hand(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            d = [int(c) for c in m[0] if c.isdigit()]
            ok = {
                "email": lambda m, d: True,
                "ip": lambda m, d: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda m, d: 14 <= len(d) <= 19 and sum(sum(divmod(2 * v, 10)) if i % 2 else v for i, v in enumerate(d[::-1])) % 10 == 0,
                "phone": lambda m, d: 10 <= len(d) <= 15,
            }[kind](m, d)
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def prose(r, n):
    return " ".join("".join(r.choice("aeinorstl") for _ in range(r.randint(2, 8))) for _ in range(n))


def datum(r):
    return r.choice([
        lambda: f"{prose(r, 1)}.{r.randint(1, 99)}@{prose(r, 1)}.example.org",
        lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        lambda: f"+1 ({r.randint(100, 999)}) {r.randint(100, 999)}-{r.randint(1000, 9999)}",
        lambda: next(c for c in iter(lambda: "".join(r.choice("0123456789") for _ in range(16)), "") if P.luhn(c)),
    ])()


@pytest.fixture(scope="module")
def model():
    r = random.Random(4)
    return P.train([" ".join([prose(r, 40), datum(r), prose(r, 40), datum(r), prose(r, 30)]) + "." for _ in range(150)], 450)


def test_base_patterns():
    r = random.Random(1)
    for _ in range(20_000):
        text = "".join(r.choice(["a", "B", "1", "12", "255", "4111", "@", ".", "-", "+", " ", "(", ")", "_", "%", "é", "\n", "4111111111111111", "x@y.z", "+1 555 123 4567"]) for _ in range(r.randint(1, 14)))
        assert P.base_spans(text) == base_by_hand(text), text
    began = time.perf_counter()
    for hard in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" + " " * 300_000, "a@" * 150_000, "1 " * 150_000, "9" * 6000 + ".1.1.1", "+1" * 150_000, "a@b" * 100_000):
        P.base_spans(hard)
    assert time.perf_counter() - began < 20


def test_gradient():
    r = np.random.default_rng(3)
    p = {k: v.astype(np.float64) for k, v in {"in": 0.3 * r.normal(size=(2, P.SYMBOLS, 4 * P.HIDDEN)) + 0.3, "u": 0.3 * r.normal(size=(2, P.HIDDEN, 4 * P.HIDDEN)), "out": r.normal(size=(2, P.HIDDEN, P.TAGS)), "bias": r.normal(size=P.TAGS), "move": r.normal(size=(P.TAGS, P.TAGS))}.items()}
    x, y = r.integers(0, 9, (4, 7)), r.integers(0, P.TAGS, (4, 7))
    _, g = P._gradient(p, x, y)
    for k, v in p.items():
        for at in r.permutation(v.size)[:12] if k != "in" else np.flatnonzero(g["in"])[:40]:
            i, losses = np.unravel_index(at, v.shape), []
            for step in (1e-5, -2e-5):
                v[i] += step
                losses.append(P.crf_gradient(P._run(p, x)[0].astype(np.float64), p["move"], y)[0])
            v[i] += 1e-5
            assert abs((losses[0] - losses[1]) / 2e-5 - g[k][i]) < 2e-3, (k, i)


def test_decoding_is_the_best_path(model):
    dec = P.Decoder(model)
    r = np.random.default_rng(5)
    windows = [r.integers(1, P.SYMBOLS, n) for n in (5, 4, 5, 1, 6)] + [P.symbols(t) for t in ("1.2.3.4", "ab@cd.ef", "+1 415 ")]
    yielded = {}
    for numbers, em in dec.emissions(windows):
        tags = dec.paths(em)
        yielded |= {w: (em[:, :, k], tags[k]) for k, w in enumerate(numbers)}
    for w, x in enumerate(windows):
        em = P._run(model, x[None].astype(np.int64))[0][0]
        em = em - em[:, :1]
        score = lambda tags: sum(em[i, t] for i, t in enumerate(tags)) + sum(dec.move[a, b] for a, b in zip((0, *tags), (*tags, 0)))  # noqa: B023, E731
        best = max(itertools.product(range(P.TAGS), repeat=min(len(x), 6)), key=score) if len(x) <= 6 else None
        if w in yielded:
            assert np.allclose(yielded[w][0], em, atol=1e-4)
            if best:
                assert abs(score(best) - score(yielded[w][1].tolist())) < 1e-3
        elif best:
            assert score(best) < 1e-3


def test_windows_hold_whole_texts(model):
    dec, r = P.Decoder(model), random.Random(8)
    mail = "jo.reno at tals dot example dot com"
    filler = prose(r, 400)
    hits = 0
    for at in range(300, 1300, 37):
        text = filler[:at] + " " + mail + " " + filler[at:]
        spans = P.reconcile(text, [], dec.candidates([text])[0])
        hits += any(k == 0 and s < at + 30 and e > at + 10 for s, k, e in spans)
        assert all(0 <= s < e <= len(text) for s, _, e in spans)
    assert hits >= 25
    texts = [filler[:200], "", mail, filler]
    shown = lambda found: [[(*x[:3], round(x[3], 2), *x[4:]) for x in q] for q in found]
    assert shown(dec.candidates(texts)) == shown([dec.candidates([t])[0] for t in texts])


def test_reconciling_takes_the_best_set():
    r = random.Random(2)
    text = "+14155552671" * 30
    for _ in range(200):
        found = []
        for _ in range(r.randint(0, 7)):
            s = r.randrange(0, 300)
            found.append((s, s + r.randint(11, 16), 3, 3.0 + r.randint(0, 9) + r.random(), False, False))
        base = [(100, 0, 130)] if r.random() < 0.5 else []
        trimmed = []
        for s, e, _, score, *_ in found:
            while not (text[s].isalnum() or text[s] == "+"):
                s += 1
            while not text[e - 1].isalnum():
                e -= 1
            if P.plausible(3, text[s:e]) and not any(s < be and e > bs for bs, _, be in base):
                trimmed.append((s, e, score))
        best = max((sum(x[2] for x in c) for n in range(len(trimmed) + 1) for c in itertools.combinations(trimmed, n) if all(a[1] <= b[0] or b[1] <= a[0] for a, b in itertools.combinations(c, 2))), default=0)
        got = [x for x in P.reconcile(text, base, found) if x not in base]
        by_span = {(s, e): max(v for a, b, v in trimmed if (a, b) == (s, e)) for s, e, _ in trimmed}
        assert abs(sum(by_span[(s, e)] for s, _, e in got) - best) < 1e-9
    cut = [(0, 6, 3, 4.0, False, True), (4, 12, 3, 5.0, True, False)]
    assert P.reconcile("+14155552671", [], cut) == [(0, 3, 12)]


def test_other_ways_to_write_are_found_and_clean_texts_left_alone(model):
    dec, r = P.Decoder(model), random.Random(77)
    forms = [(0, "mira.sole at nastel dot example dot org"), (0, "tons [at] elio [dot] net"), (3, "(415) 555-2671"), (2, "4111.1111.1111.1111"), (1, "10[.]20[.]30[.]40")]
    found = wrong = 0
    for _ in range(40):
        for k, s in forms:
            text = prose(r, 30) + " " + s + " " + prose(r, 30)
            found += any(kind == k for _, kind, _ in P.reconcile(text, [], dec.candidates([text])[0]))
        clean = prose(r, 60) + f" 2024-05-{r.randint(10, 30)} at {r.randint(1, 12)} o'clock, {r.randint(1, 9)}.{r.randint(0, 9)}.{r.randint(0, 9)} of {r.randint(100, 99999)} " + prose(r, 30)
        wrong += len(P.reconcile(clean, [], dec.candidates([clean])[0]))
    assert found >= 0.8 * 40 * len(forms) and wrong <= 1


def test_digest_on_awkward_rows(spark, model):
    mark = "write to a.b@mail.example.com or +1 (555) 123-4567, 10.0.0.255, 4111 1111 1111 1111, 日本 x@y.zz"
    rows = [*edge.rows(), (900, mark, "en", "a", 1, *edge.rows()[0][5:]), (901, "é" * 600 + mark + " " + "z" * 600 + " jo at mail dot example dot com", "en", "a", 1, *edge.rows()[0][5:])]
    docs = spark.createDataFrame(rows, edge.SCHEMA).repartition(3)
    for m in (None, model):
        got = P.digest(P.find_spans(docs, m)).collect()
        assert len(got) == len(rows)
        want = {}
        for i, t, *_ in rows:
            spans = base_by_hand(t or "")
            listed = ",".join(f"{P.KINDS[k]}:{s}:{e}" for s, k, e in spans)
            counts = tuple(sum(k == n for _, k, _ in spans) for n in range(4))
            want.setdefault((i, *counts, hashlib.sha256(listed.encode()).hexdigest()), []).append(listed)
        for q in got:
            listed = want[tuple(q)[:-1]].pop()
            assert set(filter(None, listed.split(","))) <= set(q.spans.split(",")) and (m is not None or listed == q.spans)
    assert P.digest(P.find_spans(docs.limit(0), model)).isEmpty() and P.fit(docs.limit(0)) is None and P.fit(docs.filter("doc_id in (9, 10)")) is None


def test_the_sample_depends_on_texts_alone(spark, monkeypatch):
    monkeypatch.setattr(P, "train", lambda texts: texts)
    docs = spark.createDataFrame([(i, f"x{i}@y.example.com {i}" if i % 2 else f"plain {i}") for i in range(60)] + [(99, "a@b.cd" * 20_000), (98, None)], "doc_id long, text string")
    assert P.fit(docs.repartition(3)) == P.fit(docs.repartition(5).orderBy("text")) and len(P.fit(docs)) == 60


def test_the_sample_is_drawn_by_the_same_marks(spark, monkeypatch):
    """Texts of the sample are those with the least hashes of either sort, marks found as by one expression over all forms."""
    import re

    from pyspark.sql import functions as F

    from hanmoto.llm import pii

    every = r"@|\+[0-9]|[0-9]{13}|[0-9]\.[0-9]+\.[0-9]|[0-9]{4}[ -][0-9]{4}"
    forms = ["a@b", "+1", "1234567890123", "123456789012", "1.22.3", "1..2", "1234-5678", "1234 567", "none", "1.2", "+ 1"]
    texts = [f"{f} {i % 7} x{i}" for i, f in enumerate(forms * 30)]
    for x in texts:
        assert bool("@" in x or re.search(pii.MARKED, x)) == bool(re.search(every, x))
    monkeypatch.setattr(pii, "train", lambda found, *_: found)
    monkeypatch.setattr(pii, "MOST_MARKED", 20)
    monkeypatch.setattr(pii, "MOST_OTHER", 10)
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    hashed = sorted((r.h, r.text) for r in df.select("text", F.xxhash64("text").alias("h")).collect())
    want = [[x for _, x in hashed if bool(re.search(every, x)) == m][:n] for m, n in ((True, 20), (False, 10))]
    assert pii.fit(df) == want[0] + want[1]
