"""Operators against brute force on a small table, and on rows that are awkward in every way."""

import hashlib
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from hanmoto.llm import chat_format, doc_fingerprint, line_dedup, mixing, near_copies, packing, quality_rules, simhash, sstable, suffix_dedup, toxicity
from hanmoto.llm.prefix_hash import PrefixHash, WrapHash
from hanmoto.llm.tokens import Encoder, public_path

from . import edge

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(edge.rows(), edge.SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def tokenizer(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_path(name))
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


def as_bytes(text):
    return (text or "").encode("utf-8")


def cut_by_hand(docs):
    """(id, n_bytes, n_removed, n_spans, sha256) by a table of all windows."""
    least = {}
    key = lambda i: 1 << 63 if i is None else i
    for i, t in docs:
        raw = as_bytes(t)
        for p in range(len(raw) - 49):
            w = raw[p : p + 50]
            least[w] = min(key(i), least.get(w, 1 << 64))
    out = []
    for i, t in docs:
        raw = as_bytes(t)
        gone = np.zeros(len(raw) + 1, bool)
        for p in range(len(raw) - 49):
            if least[raw[p : p + 50]] < key(i):
                gone[p : p + 50] = True
        spans = np.count_nonzero(gone[1:] > gone[:-1]) + int(gone[0])
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone[:-1]])
        out.append((i, len(raw), int(gone.sum()), int(spans), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("how", [{}, {"block": 3000}, {"block": 3000, "hot": 3, "crowd": 2}])
def test_suffix_dedup_matches_brute_force(docs, texts, how):
    assert Counter(tuple(r) for r in suffix_dedup.digest(suffix_dedup.remove_repeats(docs, **how)).collect()) == cut_by_hand(texts)


def test_texts_with_one_equal_hash_stay(spark, monkeypatch):
    real = F.xxhash64
    monkeypatch.setattr(near_copies.F, "xxhash64", lambda *c: F.lit(7).cast("long") if len(c) == 1 else real(*c))
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(20))) for i in range(6)] + [(9, " ".join(f"w3x{k}" for k in range(20)))]
    kept = near_copies.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == list(range(6))


@pytest.mark.parametrize("hot", [2, suffix_dedup.HOT])
def test_hot_phrases_lose_no_window(spark, hot):
    r = np.random.default_rng(21)
    prose = lambda n: bytes(r.integers(97, 123, n).astype(np.uint8)).decode()
    phrase, passage, contexts = prose(45), prose(130), [prose(6) for _ in range(8)]
    rows = []
    for i in range(300):
        lead, tail = contexts[int(r.integers(0, 8))], contexts[int(r.integers(0, 8))]
        rows.append((i % 290, prose(40) + lead + phrase + tail + prose(30) + (passage[int(r.integers(0, 40)) :] if i % 3 else "")))
    own = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter(tuple(x) for x in suffix_dedup.digest(suffix_dedup.remove_repeats(own, block=2000, hot=hot, crowd=7)).collect())
    assert got == cut_by_hand(rows) and sum(x[2] for x in got) > 10_000


def test_the_largest_id_is_not_null(spark):
    text, least, most = "".join(map(str, range(60))), -(2**63), 2**63 - 1
    for rows in ([(most, text[:88]), (None, text[:88] + "!!")], [(most, text), (None, text), (least, "a" * 70), (least + 1, "b" * 70), (None, "b" * 80)], [(most, text), (3, text)]):
        own = spark.createDataFrame(rows, "doc_id long, text string")
        got = Counter(tuple(x) for x in suffix_dedup.digest(suffix_dedup.remove_repeats(own)).collect())
        assert got == cut_by_hand(rows) and sum(x[2] for x in got) > 50


def packed_segments(n, hashes, docs):
    """As many segments of one anchor as hashes, in blocks of 1,000."""
    import zstandard

    blocks = [slice(i, i + 1000) for i in range(0, n, 1000)]
    side = np.full(n, 77, np.uint64)
    columns = ((np.full(n, 5, np.uint64), 8), (hashes.astype(np.uint64), 6), (docs.astype(np.int64).view(np.uint64), 8), (side, 2), (side, 2))
    rows = [zstandard.ZstdCompressor(level=1).compress(b"".join(suffix_dedup._planes(c[b].copy(), w) for c, w in columns)) for b in blocks]
    return pa.table({"part": [0] * len(blocks), "block": list(range(len(blocks))), "rows": pa.array(rows, pa.binary())})


def test_a_hot_anchor_is_many_groups():
    n = 100_000
    lists = lambda t, k, kind="<u4": [np.frombuffer(x, kind) for x in t.column(k).to_pylist()]
    settle = suffix_dedup._settle_segments(4096, 2048)
    # in 10^5 contexts: each window goes to its own group
    apart = settle(packed_segments(n, np.arange(n), np.arange(n)))
    assert sum(map(len, lists(apart, "split"))) == n and not any(len(x) for k in ("plain", "sorted", "named") for x in lists(apart, k))
    # in 10^5 copies: crowds, each with the witness
    equal = settle(packed_segments(n, np.full(n, 9), np.arange(n)))
    names = np.concatenate(lists(equal, "names", "<u8"))
    crowds = Counter(names.tolist())
    assert max(crowds.values()) == 2049 and sum(crowds.values()) == n - 1 + len(crowds) and len(crowds) == -(-(n - 1) // 2048)
    assert len(lists(equal, "named")[0]) == 999 + len(crowds)
    few = settle(packed_segments(3000, np.arange(3000) // 2, np.arange(3000)))
    assert sum(map(len, lists(few, "sorted"))) == 1500 == sum(map(len, lists(few, "plain")))


def test_suffix_dedup_gives_spans_and_bytes(spark):
    passage = "a passage of more than fifty bytes that is in two documents, word by word. "
    own = spark.createDataFrame([(1, "first " + passage), (2, passage + "second"), (3, "nothing shared")], "doc_id long, text string")
    rows = {r.doc_id: r for r in suffix_dedup.remove_repeats(own).collect()}
    assert bytes(rows[2].kept) == b"second" and rows[1].spans == [] and bytes(rows[3].kept) == b"nothing shared"
    assert [(s.start, s.end) for s in rows[2].spans] == [(0, len(passage))]


def test_suffix_sort_sorts():
    r = np.random.default_rng(1)
    text = r.integers(97, 99, 4000).astype(np.uint8)
    pos = r.integers(0, 3900, 700)
    group = np.sort(r.integers(0, 5, 700))
    s = suffix_dedup.SuffixSort(text)
    order = s.sort(pos, group)
    keys = [(g, text[p : p + 50].tobytes()) for g, p in zip(group[order], pos[order], strict=True)]
    assert keys == sorted(keys)
    assert s.same_as_before(pos[order], group[order]).tolist() == [False, *(a == b for a, b in zip(keys, keys[1:], strict=False))]


def test_prefix_hashes_find_common_extensions():
    data = np.frombuffer(b"abracadabra" * 30 + b"x" + b"abracadabra" * 20, np.uint8)
    p, w = PrefixHash(data), WrapHash(data)
    a, b = np.array([0, 5, 331]), np.array([11, 16, 0])
    expect = []
    for x, y in zip(a, b, strict=True):
        n = 0
        while n < 100 and data[x + n] == data[y + n]:
            n += 1
        expect.append(n)
    assert p.common(a, b, np.full(3, 100)).tolist() == expect == w.common(a, b, 100).tolist()
    assert (p.windows(11)[0] == p.span(np.array([11]), np.array([11]))).all()


def quality_by_hand(text):
    w = (text or "").encode().split()
    w = [x.decode() for x in w]
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_match_brute_force(docs, texts):
    got = Counter(tuple(r[:7]) for r in quality_rules.quality(docs).collect())
    expect = Counter()
    for i, t in texts:
        c = quality_by_hand(t)
        expect[(i, *c, c[0] < 20 or 100 * c[4] > 30 * c[0])] += 1
    assert got == expect


def test_bad_hosts_take_their_documents_along(spark):
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(i, "too short", "bad") for i in range(60)] + [(100, good, "bad")] + [(200 + i, good + str(i), "fine") for i in range(60)]
    own = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in quality_rules.quality(own).filter("kept").collect()}
    assert kept == {200 + i for i in range(60)}
    assert {r.doc_id for r in quality_rules.keep_good(own).collect()} == kept


def test_toxicity_learns_words_and_characters(spark):
    r = np.random.default_rng(3)
    word = lambda: "".join(r.choice(list("aeioubcdfg"), r.integers(2, 7)))
    rows, labels = [], []
    for i in range(900):
        w = [word() for _ in range(int(r.integers(20, 90)))]
        toxic = i % 2
        if toxic:
            for k in range(3):
                w[int(r.integers(0, len(w)))] = "zzvile" + word() if (i + k) % 4 == 1 else "horrid"
        rows.append((i, " ".join(w)))
        labels.append((i, 1, toxic))
    own, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in toxicity.score(own, toxicity.fit(own, known)).collect()}
    test = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (i in set(test)) for i in got)
    assert np.mean([got[i].predicted == i % 2 for i in test]) > 0.85
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in got.values())


def score_by_hand(model, text):
    """A plain loop over windows and words."""
    p, own = model.network.p, text.lower().split()
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    n, width = len(own), toxicity.WINDOW
    if not own:
        return 0.0
    starts = sorted({*range(0, max(1, n - width), toxicity.STRIDE), max(0, n - width)})
    best = -np.inf
    for s in starts:
        xs = []
        for w in own[s : s + width]:
            core = toxicity.base(w)
            k = model.known.get(core, 0)
            x = p["word"][k] + np.mean([p["gram"][g] for g in toxicity.grams([core])[0]], axis=0)
            xs.append(x + np.eye(toxicity.DIM)[0] * model.evidence[k])
        sides = []
        for d in "fb":
            h, seen = np.zeros(toxicity.HIDDEN), []
            for x in xs if d == "f" else xs[::-1]:
                gate, back, m = x @ p[f"in_{d}"] + p[f"bias_{d}"], h @ p[f"re_{d}"], toxicity.HIDDEN
                z, r = sigmoid(gate[:m] + back[:m]), sigmoid(gate[m : 2 * m] + back[m : 2 * m])
                h = z * h + (1 - z) * np.tanh(gate[2 * m :] + r * back[2 * m :])
                seen.append(h)
            sides.append(seen if d == "f" else seen[::-1])
        states = np.concatenate([np.array(x) for x in sides], axis=1)
        e = np.exp(np.tanh(states @ p["att"]) @ p["att_v"])
        best = max(best, float((e / e.sum()) @ states @ p["out"] + p["out_b"][0]))
    return float(sigmoid(model.scale * best + model.shift))


def test_scores_are_those_of_a_plain_loop():
    r = np.random.default_rng(17)
    word = lambda: "".join(r.choice(list("abcde"), r.integers(1, 5)))
    texts = [" ".join(["vile" if i % 2 and k % 19 == 7 else word() for k in range(int(r.integers(1, 150)))]) for i in range(240)]
    model = toxicity.train(texts, [i % 2 for i in range(240)])
    some = [*texts[:40], "", " ", "one", " ".join(texts[:9]), "Vile, (vile) 日本語 été"]
    want = [score_by_hand(model, t) for t in some]
    assert model.evidence.max() > 0 and model.scores(some) == pytest.approx(want, abs=1e-4)
    assert model.scores([None]).tolist() == [0.0]


def test_network_gradients():
    r = np.random.default_rng(0)
    net = toxicity.Network(5)
    x = r.normal(0, 0.5, (6, toxicity.DIM)).astype(np.float32)
    codes = r.integers(0, 6, (4, 7))
    codes[1, 4:] = -1
    cache: dict = {}
    out = net.run(net.gates(x), codes, cache)
    d = r.normal(size=4).astype(np.float32)
    grad, _, used = net.gradients(codes, cache, d)
    for name in ("re_f", "re_b", "att", "att_v", "out"):
        at = tuple(0 for _ in net.p[name].shape)
        old = net.p[name][at]
        f = []
        for e in (1e-2, -1e-2):
            net.p[name][at] = old + e
            f.append(float(net.run(net.gates(x), codes) @ d))
        net.p[name][at] = old
        assert grad[name][at] == pytest.approx((f[0] - f[1]) / 2e-2, abs=5e-3)
    assert out.shape == (4,) and set(used) == set(codes[codes >= 0])


def test_awkward_rows_are_scored(spark, docs):
    known = spark.createDataFrame([(i, i % 2) for i in range(100, 120)] + [(None, 1), (1, 0), (1, 1)], "doc_id long, toxic int")
    rows = toxicity.score(docs, toxicity.fit(docs, known)).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert {r.score for r in rows if r.doc_id in (4, 5, 6)} == {0.0} and not any(r.held_out for r in rows if r.doc_id is None)


def test_windows_cover_everything():
    for n in (1, 31, 32, 33, 55, 56, 57, 200):
        w = toxicity.windows(np.arange(n))
        passage = toxicity.WINDOW - toxicity.STRIDE + 1
        assert all(any(set(range(i, i + passage)) <= set(row.tolist()) for row in w) for i in range(n - passage + 1))
        assert set(w[w >= 0].ravel().tolist()) == set(range(n))
        assert all((np.diff(row[row >= 0]) == 1).all() for row in w)


@pytest.mark.parametrize("name", [WORD, BYTE])
def test_encoder_gives_the_tokenizers_ids(name, texts):
    encode, enc = tokenizer(name), Encoder(public_path(name), 1)
    more = ["it's don't I'LL we've'd ''s .'s", " \n\n a\n b \t c", "a  b\x1cz \x85 q", "naïve ÀÉ ǅ ŉ ß İi ΣΑΣ", "１２３ 12 3½ ²a", "é café", "日本語 テスト", "ªº µ", "à́ "]
    all_texts = [t for _, t in texts] + more
    for t, ids in zip(all_texts, enc.encode(all_texts), strict=True):
        assert ids.tolist() == encode(t), t and t[:50]


def test_shards_round_trip(spark, docs, texts):
    folder, manifest = sstable.write_shards(docs, public_path(WORD))
    rows = sstable.read_shards(spark, folder, manifest).collect()
    encode = tokenizer(WORD)
    want = Counter((i, tuple(encode(t))) for i, t in texts)
    ids = lambda r: tuple(np.frombuffer(r.ids, "<u4").tolist())
    assert Counter((r.doc_id, ids(r)) for r in rows) == want
    rows.sort(key=lambda r: r.start)
    at, key = 0, lambda i: -(2**64) if i is None else i
    assert [key(r.doc_id) for r in rows] == sorted(key(r.doc_id) for r in rows)
    for r in rows:
        assert r.start == at
        at += len(r.ids) // 4


def test_a_shard_answers_lookups():
    w = sstable.Writer(4)
    keys = sorted([None, *range(-50, 400, 3), 7, 7, 2**62], key=lambda i: -(2**64) if i is None else i)
    for n, k in enumerate(keys):
        w.add(sstable.to_key(k), np.arange(n % 900, n % 900 + 300))
    data = w.finish()
    r = sstable.Reader(data)
    assert len(r.at) > 3 and r.entries == len(keys)
    for k in set(keys):
        got = r.get(k)
        assert [g[0] for g in got] == [n % 900 for n, x in enumerate(keys) if x == k]
    assert r.get(2) == [] and r.get(10**15) == []
    with pytest.raises(ValueError):
        sstable.Reader(data[:-1] + b"\0")
    damaged = bytearray(data)
    damaged[-sstable.FOOTER.size - 3] ^= 255
    with pytest.raises(ValueError):
        sstable.Reader(bytes(damaged))


def simhash_by_hand(text, k=3):
    w = (text or "").encode().lower().split()
    parts = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_by_hand(nodes, linked):
    parent = list(range(len(nodes)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(len(nodes)):
        for b in range(a):
            if linked(nodes[a], nodes[b]):
                parent[find(a)] = find(b)
    return [find(x) for x in range(len(nodes))]


def test_simhash_groups_match_brute_force(docs, texts):
    prints = [(i, simhash_by_hand(t)) for i, t in texts]
    root = components_by_hand(prints, lambda a, b: (a[1] ^ b[1]).bit_count() <= 3)
    least = {}
    for (i, _), r in zip(prints, root, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = Counter((i, p, least.get(r)) for (i, p), r in zip(prints, root, strict=True))
    got = Counter((r.doc_id, r.bits & (1 << 64) - 1, r.component_id) for r in simhash.near_groups(docs).collect())
    assert got == want


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = " ".join(f"w{i * 7919 % 1000}" for i in range(3000))
    whole = simhash.fingerprint(text, 3)
    monkeypatch.setattr(simhash, "CHUNK", 1000)
    assert simhash.fingerprint(text, 3) == whole == (simhash_by_hand(text) ^ 1 << 63) - (1 << 63)


@pytest.mark.parametrize("radius", [1, 3])
def test_every_pair_in_the_radius_meets_in_a_table(radius):
    r = np.random.default_rng(2)
    m = simhash.masks(radius)
    for _ in range(300):
        diff = np.bitwise_or.reduce(np.uint64(1) << r.choice(64, radius, replace=False).astype(np.uint64))
        assert ((m & diff) == 0).any()


def test_links_connect_all_near_fingerprints(spark):
    r = np.random.default_rng(4)
    bases = r.integers(-(1 << 62), 1 << 62, 60)
    near = [int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in bases for i, j in r.integers(0, 62, (6, 2))]
    bits = sorted({*map(int, bases), *near})
    nodes = spark.createDataFrame([(b, b) for b in bits], "bits long, node long").cache()
    got = {x.node: x.label for x in simhash.components(simhash.links(nodes)).collect()}
    root = components_by_hand(bits, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 3)
    for x in range(len(bits)):
        mine = [y for y in range(len(bits)) if root[y] == root[x]]
        assert got.get(bits[x], bits[x]) == min(bits[y] for y in mine)


def test_crowded_buckets_keep_their_links(monkeypatch):
    r = np.random.default_rng(6)
    bits = np.unique(r.integers(0, 1 << 14, 900).astype(np.uint64))
    monkeypatch.setattr(simhash, "DENSE", 64)
    p, c = simhash._forest(bits, 1, np.arange(14))
    edges = set(zip(p.tolist(), c.tolist(), strict=True))
    of = components_by_hand(list(range(len(bits))), lambda a, b: (a, b) in edges or (b, a) in edges)
    want = components_by_hand([int(b) for b in bits], lambda a, b: (a ^ b).bit_count() <= 1)
    assert Counter(Counter(of).values()) == Counter(Counter(want).values())


def test_near_copies_leave_one_of_each_group(spark, docs):
    r = np.random.default_rng(8)
    word = lambda: "".join(r.choice(list("abcdefghij"), 5))
    rows, n = [], 0
    for g in range(12):
        base = [word() for _ in range(400)]
        for _ in range(4):
            w = list(base)
            w[int(r.integers(0, 400))] = word()
            rows.append((n, " ".join(w), g))
            n += 1
    own = spark.createDataFrame(rows, "doc_id long, text string, g int")
    kept = sorted((x.g, x.doc_id) for x in near_copies.drop_near_copies(own).collect())
    assert kept == [(g, 4 * g) for g in range(12)]
    assert near_copies.drop_near_copies(docs).columns == docs.columns


@pytest.mark.parametrize("kind", ["replaced", "appended"])
def test_near_copies_that_differ_by_a_passage_are_found(spark, kind):
    r = np.random.default_rng(12)
    words = lambda n: [f"w{x}" for x in r.integers(0, 50_000, n)]
    rows = []
    for g in range(40):
        base, at = words(400), int(r.integers(0, 360))
        other = [*base[:at], *words(36), *base[at + 36 :]] if kind == "replaced" else [*words(40), *base, *words(40)]
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(other))]
    sets = [near_copies.read_set(near_copies.shingle_set(t)) for _, t in rows]
    assert all(0.8 <= near_copies.jaccard(sets[2 * g], sets[2 * g + 1]) < 0.84 for g in range(40))
    own = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(x.doc_id for x in near_copies.drop_near_copies(own).collect()) == list(range(0, 80, 2))


def test_blocks_find_every_link(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 5)
    r = np.random.default_rng(10)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for k in r.integers(0, 120, r.integers(1, 6)):
            w[int(k)] = f"x{i}-{k}"
        rows.append((i, " ".join(w)))
    own = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [near_copies.read_set(near_copies.shingle_set(t)) for _, t in rows]
    counts = near_copies.common_counts(sets[:9], sets[9:], 50)
    assert counts.tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in sets[9:]] for a in sets[:9]]
    root = components_by_hand(sets, lambda a, b: near_copies.jaccard(a, b) >= 0.8)
    want = Counter(root)
    monkeypatch.setattr(near_copies, "CANDIDATE_RADIUS", 4)
    kept = {x.doc_id for x in near_copies.drop_near_copies(own).collect()}
    missing = {min(i for i in range(60) if root[i] == g) for g in want} - kept
    assert not missing and len(kept) <= len(want) + 3


def test_shingle_sets_round_trip():
    s = near_copies.read_set(near_copies.shingle_set("a b c d e f g a b c d e"))
    assert len(s) == 7 and (np.diff(s.astype(np.int64)) > 0).all() and near_copies.jaccard(s, s) == 1
    assert near_copies.jaccard(near_copies.read_set(near_copies.shingle_set(None)), s) == 0


def targets_by_hand(sizes):
    """Water-filling by bisection."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, lo, hi = 1.5 * sum(sizes.values()), 0.0, 4.0 * sum(sizes.values()) + 1
    for _ in range(200):
        mid = (lo + hi) / 2
        if sum(min(2 * sizes[s], mid * weight[s]) for s in names) < total:
            lo = mid
        else:
            hi = mid
    return {s: min(2 * sizes[s], hi * weight[s]) for s in names}


def test_mix_meets_its_targets(spark, docs):
    rows = mixing.mix_plan(docs).collect()
    again = mixing.mix_plan(docs.repartition(5)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    source = defaultdict(set)
    for r in docs.collect():
        source[(r.doc_id, len((r.text or "").encode().split()))].add(r.source)
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += len((r.text or "").encode().split())
    want = targets_by_hand(dict(sizes))
    by = {(r.source_size): s for s in sizes for r in rows if r.source_size == sizes[s]}
    taken = Counter()
    for r in rows:
        assert r.taken <= 2 * r.size and r.taken % max(r.size, 1) == 0
        s = by[r.source_size]
        assert r.target == pytest.approx(want[s], rel=1e-9)
        taken[s] += r.taken
    # few documents of very different sizes: one of them is rounded alone
    largest = max(r.size for r in rows)
    assert all(abs(taken[s] - want[s]) <= largest for s in sizes)


def test_pivot_keeps_the_sum():
    r = np.random.default_rng(9)
    size, p = r.integers(1, 500, 300), np.full(300, 0.37)
    out = mixing.pivot(p, size, r)
    assert (out * size).sum() == pytest.approx((p * size).sum())
    assert np.count_nonzero((out > 0) & (out < 1)) <= 1
    mean = np.mean([mixing.pivot(p[:6], size[:6], np.random.default_rng(k)) for k in range(3000)], axis=0)
    assert np.abs(mean - 0.37).max() < 0.05
    own = np.array([0.9, 0.2, 0.5, 0.7, 0.05])
    mean = np.mean([mixing.pivot(own, np.array([900, 80, 70, 5, 1]), np.random.default_rng(k)) for k in range(4000)], axis=0)
    assert np.abs(mean - own).max() < 0.05


def test_mixing_in_many_slices(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE", 10)
    monkeypatch.setattr(mixing, "FAN", 3)
    own = spark.createDataFrame([(i, "w " * (1 + i % 17), f"s{i % 4}") for i in range(400)], "doc_id long, text string, source string")
    rows = mixing.mix_plan(own).collect()
    taken, target = Counter(), {}
    for r in rows:
        taken[r.doc_id % 4] += r.taken
        target[r.doc_id % 4] = r.target
    assert all(abs(taken[s] - target[s]) <= 2 for s in range(4))


def test_what_is_left_fractional_is_small(spark):
    r = np.random.default_rng(13)
    sizes = np.clip(np.exp(r.normal(4, 1, 6000)), 1, 5000).astype(int).tolist()
    own = spark.createDataFrame([(i, "w " * n, "ab"[i % 3 == 0]) for i, n in enumerate(sizes)], "doc_id long, text string, source string")
    taken, target = Counter(), {}
    for x in mixing.mix_plan(own).collect():
        taken[x.source_size] += x.taken
        target[x.source_size] = x.target
    assert len(target) == 2 and all(abs(taken[s] - target[s]) <= 5 for s in target)  # the median document has 55 words


def test_equal_rows_are_counted_before_they_are_rounded(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE", 10)
    rows = [(7, "same words here", "a", i) for i in range(300)] + [(1000 + i, "w " * (2 + i % 9), "ab"[i % 2], i) for i in range(100)] + [(None, "x", None, 0)] * 5
    own = spark.createDataFrame(rows, "doc_id long, text string, source string, n long")
    for docs in (own, own.repartition(7)):
        got = mixing.mix_plan(docs).collect()
        assert len(got) == len(rows)
        equal = Counter(r.taken for r in got if r.doc_id == 7)
        assert len(equal) <= 2 and sum(equal.values()) == 300
        taken, target = Counter(), {}
        for r in got:
            taken[r.source_size] += r.taken
            target[r.source_size] = r.target
        assert all(abs(taken[s] - target[s]) <= 3 for s in taken)
    assert mixing.mix(own).filter("doc_id = 7").count() * 3 == sum(r.taken for r in got if r.doc_id == 7)


def test_mixed_documents_are_whole_rows(spark, docs):
    plan = Counter()
    for r in mixing.mix_plan(docs).collect():
        plan[r.doc_id] += r.copies
    out = mixing.mix(docs)
    assert out.columns == docs.columns and Counter(r.doc_id for r in out.collect()) == +plan


def test_site_lines_are_dropped(spark, docs):
    rows = [(i, f"Menu\nunique {i}\n \nMenu\nend", "h") for i in range(20)] + [(100 + i, f"Menu\nother {i}", "g") for i in range(4)] + [(200, None, "h")]
    own = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in line_dedup.drop_site_lines(own).collect()}
    assert got[3].text == "unique 3\n " and (got[3].n_lines, got[3].n_dropped) == (5, 3)
    assert got[101].text == "Menu\nother 1" and got[200].text is None
    assert line_dedup.drop_site_lines(docs).columns == [*docs.columns, "n_lines", "n_dropped"]
    clash = own.withColumn("n_lines", F.lit(-1)).withColumn("_host", F.lit("x"))
    out = line_dedup.drop_site_lines(clash)
    assert out.columns == ["doc_id", "text", "source", "n_lines", "_host", "n_lines_", "n_dropped"]
    assert out.filter("doc_id = 3 and n_lines = -1 and _host = 'x' and n_lines_ = 5 and n_dropped = 3").count() == 1


def test_pages_of_many_lines_take_time_in_proportion(spark):
    long = [(i, "\n".join([f"menu {k}" for k in range(2000)] + [f"{i} {k}" for k in range(250_000)]), "h") for i in range(6)]
    own = spark.createDataFrame(long, "doc_id long, text string, source string").repartition(6)
    began = time.monotonic()
    rows = line_dedup.drop_site_lines(own).select("doc_id", "n_lines", "n_dropped", F.length("text").alias("n")).collect()
    assert time.monotonic() - began < 60
    assert {(r.n_lines, r.n_dropped) for r in rows} == {(252_000, 2000)}
    assert {r.doc_id: r.n for r in rows} == {i: len("\n".join(t.split("\n")[2000:])) for i, t, _ in long}


def test_chats_read_back_and_are_validated(spark):
    turns = [
        (1, 1, "user", "hi"), (1, 2, "assistant", "a \\ ### b</turn>\n\\t"), (2, 2, "assistant", None), (2, 1, "user", "### user: x"), (2, 1, "user", "### user: x"),
        (None, 1, "odd: role</turn>", "\\\\"), (3, None, "system", ""), (3, 0, "user", "\\h"), (3, 1, "assistant", "</turn></turn>"),
    ]
    own = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.parse_chats(chat_format.format_chats(own)).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "hi"), ("assistant", "a \\ ### b</turn>\n\\t")]
    assert got[1].valid and got[3].valid and not got[2].valid and not got[None].valid
    assert [(t.role, t.text) for t in got[2].turns] == [("user", "### user: x")] * 2 + [("assistant", "")]
    assert [(t.role, t.text) for t in got[None].turns] == [("odd: role</turn>", "\\\\")]
    assert got[3].loss_text == "</turn></turn>" and got[1].loss_text == "a \\ ### b</turn>\n\\t"
    assert chat_format.format_chats(own.limit(0)).count() == 0


def test_templates_with_marks_that_regular_expressions_know(spark):
    marks = {"<|im_end|>": "e", "<|im_start|>": "s", "[.*]": "x"}
    template = chat_format.Template(open="<|im_start|>", separator="[.*]", close="<|im_end|>", end="$", escapes=marks, role_escapes=marks)
    turns = [(1, 1, "user", "a <|im_end|>$ b | [.*] \\E \\e"), (1, 2, "assistant", "<|im_start|>user[.*]"), (2, 1, "[.*]", "im_end")]
    own = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.parse_chats(chat_format.format_chats(own, template), template).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [x[2:] for x in turns[:2]] and got[1].valid and got[1].loss_text == turns[1][3]
    assert [(t.role, t.text) for t in got[2].turns] == [("[.*]", "im_end")]


def test_packing_places_every_id_once(spark, docs, texts):
    rows = packing.pack(docs, public_path(BYTE)).collect()
    encode = tokenizer(BYTE)
    want = Counter((i, tuple(encode(t))) for i, t in texts)
    sequences = defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 2048
    assert sorted(sequences) == list(range(len(sequences)))
    whole = Counter()
    for (i, ids), n in want.items():
        for s in range(0, len(ids), 2048):
            whole[(i, s, ids[s : s + 2048])] += n
    assert Counter((r.doc_id, r.start, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in rows) == whole
    assert sum(len(x.ids) for x in packing.sequences(packing.pack(docs, public_path(BYTE))).collect()) == sum(len(r.ids) for r in rows)


def test_pack_plan_is_tight():
    r = np.random.default_rng(5)
    counts = Counter(r.integers(1, 2049, 20_000).tolist())
    slots = packing.plan(dict(counts))
    used = Counter()
    for s in slots:
        for k in range(s.count):
            used[s.sequence + k] += s.length
    assert Counter({n: c for n, c in ((L, sum(s.count for s in slots if s.length == L)) for L in counts)}) == counts
    assert max(used.values()) <= 2048 and sum(used.values()) / (2048 * len(used)) > 0.97
    assert packing.plan({}) == []


@pytest.mark.parametrize("hot", [5, 100, 700])
def test_pack_plan_is_tight_with_a_hot_length(hot):
    r = np.random.default_rng(7)
    counts = Counter([hot] * 10_000 + np.clip(np.exp(r.normal(np.log(300), 1, 20_000)), 1, 2048).astype(int).tolist())
    for histogram in ({hot: counts[hot]}, dict(counts)):
        slots = packing.plan(histogram)
        used, placed = Counter(), Counter()
        for s in slots:
            placed[s.length] += s.count
            for k in range(s.count):
                assert used[s.sequence + k] == s.offset
                used[s.sequence + k] += s.length
        assert placed == histogram and max(used.values()) <= 2048 and sorted(used) == list(range(len(used)))
        assert len(used) == -(-counts[hot] // (2048 // hot)) if len(histogram) == 1 else sum(used.values()) / (2048 * len(used)) > 0.95


def test_fingerprints_and_next_documents(docs, texts):
    rows = doc_fingerprint.compare_with_next(docs).collect()
    assert len(rows) == len(texts)
    # ids that occur once and are followed by one that occurs once have a single right answer
    count = Counter(i for i, _ in texts)
    order = sorted((i for i in count if i is not None), reverse=True)
    by = dict(texts)
    checked = 0
    for r in rows:
        if r.doc_id is not None and count[r.doc_id] == 1:
            k = order.index(r.doc_id)
            if k + 1 < len(order) and count[order[k + 1]] == 1:
                mine, following = by[r.doc_id] or "", by[order[k + 1]] or ""
                text = doc_fingerprint.edited(mine, following)
                assert (r.n_chars, r.edited_sha256) == (len(mine), hashlib.sha256(text.encode()).hexdigest())
                assert r.fingerprint == doc_fingerprint.fingerprint(mine) and r.edited_fingerprint == doc_fingerprint.fingerprint(text)
                assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
                checked += 1
    assert checked > 15
    same = {r.fingerprint for r in rows if r.doc_id == 1}
    assert len(same) == 1


def test_likeness_estimates_the_common_share(monkeypatch):
    r = np.random.default_rng(7)
    word = lambda: "".join(r.choice(list("abcdefghij"), 6))
    a, b = " ".join(word() for _ in range(2000)), " ".join(word() for _ in range(2000))
    f = doc_fingerprint.fingerprint
    assert doc_fingerprint.likeness(f(a), f(a)) == 1 and doc_fingerprint.likeness(f(a), f(b)) < 0.05
    assert 0.35 < doc_fingerprint.likeness(f(a), f(doc_fingerprint.edited(a, b))) < 0.65
    assert doc_fingerprint.likeness(f(""), f("")) == 1 and doc_fingerprint.likeness(f(""), f(a)) == 0
    whole = f(a)
    monkeypatch.setattr(doc_fingerprint, "CHUNK", 777)
    assert f(a) == whole


def dice(a, b, k):
    """The exact share of distinct k-byte spans."""
    x, y = ({t[i : i + k] for i in range(len(t) - k + 1)} for t in (a.encode(), b.encode()))
    return 2 * len(x & y) / max(1, len(x) + len(y))


def test_likeness_is_near_the_exact_share():
    r = np.random.default_rng(31)
    word = lambda: "".join(r.choice(list("abcdefghij"), int(r.integers(2, 9))))
    prose = lambda n: " ".join(word() for _ in range(n))
    f = doc_fingerprint.fingerprint
    errors, plain = [], []
    for _ in range(60):
        a, b = prose(int(r.integers(80, 3000))), prose(int(r.integers(80, 3000)))
        cut = int(r.integers(0, len(a)))
        others = [doc_fingerprint.edited(a, b), a[:cut] + prose(9) + a[cut:], prose(5) + a + prose(200), a[cut:] + a[:cut], b]
        for other in others:
            exact = dice(a, other, doc_fingerprint.SPAN)
            errors.append(abs(doc_fingerprint.likeness(f(a), f(other)) - exact))
            plain.append(abs(doc_fingerprint.spans_in_common(f(a).split("."), f(other).split(".")) - exact))
    assert np.mean(errors) < 0.025 and np.max(errors) < 0.2 and np.mean(errors) < np.mean(plain)
    edits = errors[::5]
    assert np.quantile(edits, 0.95) < 0.06 and np.mean(edits) < 0.025


def test_extensions_are_those_of_the_texts():
    r = np.random.default_rng(33)
    f = lambda t: doc_fingerprint.fingerprint(t).split(".")
    letters = lambda n: bytes(r.integers(97, 101, n).astype(np.uint8)).decode()
    for _ in range(300):
        n, m = (int(x) for x in r.integers(1, 5000, 2))
        head, tail = int(r.integers(0, n)), int(r.integers(0, n))
        a = letters(n)
        b = a[:head] + "#" + letters(m) + "%" + (a[n - tail :] if tail else "")
        x, y = f(a), f(b)
        step = max(doc_fingerprint.space(n), doc_fingerprint.space(len(b)))
        front = doc_fingerprint.extension(x[2], y[2], n, len(b))
        back = doc_fingerprint.extension(x[3], y[3], n, len(b))
        assert abs(front - head) <= step and abs(back - tail) <= step


@pytest.mark.parametrize("name", ["suffix", "quality", "good", "simhash", "near", "plan", "mix", "lines", "pack", "prints", "shards", "toxic", "toxic without labels", "chats"])
def test_empty_tables(spark, docs, name):
    none = docs.limit(0)

    def shards(d):
        folder, manifest = sstable.write_shards(d, public_path(WORD))
        return sstable.read_shards(spark, folder, manifest)

    def toxic(d):
        known = spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
        return toxicity.score(d, toxicity.fit(d, known))

    f = {
        "toxic": toxic, "toxic without labels": lambda d: toxicity.score(d, toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))), "chats": lambda d: chat_format.parse_chats(chat_format.format_chats(d.selectExpr("doc_id AS conv_id", "rows AS turn", "lang AS role", "text"))),
        "suffix": suffix_dedup.remove_repeats, "quality": quality_rules.quality, "good": quality_rules.keep_good, "simhash": simhash.near_groups, "near": near_copies.drop_near_copies, "plan": mixing.mix_plan,
        "mix": mixing.mix, "lines": line_dedup.drop_site_lines, "pack": lambda d: packing.pack(d, public_path(BYTE)), "prints": doc_fingerprint.compare_with_next, "shards": shards,
    }[name]
    assert f(none).count() == 0


def test_powers_are_kept_for_texts_of_all_lengths():
    """A table of powers is made once, not anew whenever a text of another length comes."""
    from hanmoto.llm import prefix_hash

    lengths = [1 << k for k in range(15)]
    for n in lengths:
        for r in range(2):
            for inverse in (False, True):
                base = pow(prefix_hash.BASES[r], -1, prefix_hash.PRIME) if inverse else prefix_hash.BASES[r]
                got = prefix_hash.powers(r, n, inverse)
                assert len(got) == n and [int(got[i]) for i in (0, n // 2, n - 1)] == [pow(base, i, prefix_hash.PRIME) for i in (0, n // 2, n - 1)]
    asked = [(r, n, inverse) for n in lengths for r in range(2) for inverse in (False, True)]
    kept = [prefix_hash.powers(*x) for x in asked]
    assert all(np.shares_memory(a, prefix_hash.powers(*x)) for a, x in zip(kept, asked, strict=True))


def test_reduction_modulo_the_prime():
    from hanmoto.llm.prefix_hash import PRIME, reduce

    xs = [0, 1, PRIME - 1, PRIME, PRIME + 1, 2 * PRIME, 1 << 31, 1 << 32, (PRIME - 1) ** 2, (1 << 62) - 1]
    assert reduce(np.array(xs, np.uint64)).tolist() == [x % PRIME for x in xs]
