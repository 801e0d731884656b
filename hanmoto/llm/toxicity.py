"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, in numpy.

A step is a word. Its input is a vector of the word itself (if the training sample knows it) plus the mean vector of its
character n-grams, so that unseen forms still have meaning. Windows of WINDOW words start every STRIDE words and so overlap; a document scores as its
highest window. Only the document's label is known in training, so each document teaches through its highest windows.

A word's first component also carries evidence: how much more often than by chance its documents have one label. A document is trained with
the evidence of other documents only, so that the network learns how far to trust it; with few labels that is most of what can be learned.

Training takes a bounded sample (MOST_TOXIC, MOST_CLEAN, MOST_BYTES, SAMPLE_BYTES) of the labelled rows; scoring reads every word of every
text. Of two windows in a row WINDOW - STRIDE words are common, so that a passage of up to WINDOW - STRIDE + 1 words is whole in one of them.

Defined results: a null or blank text has no window and scores 0; a null id is never held out nor learned from; an id with
several labels counts as toxic if one says so; repeated documents are scored each; without both kinds of labels every score is 0;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Texts of either label in the training sample, bytes of one of them, bytes of all of one label.
MOST_TOXIC, MOST_CLEAN, MOST_BYTES, SAMPLE_BYTES = 1500, 3000, 100_000, 24 << 20
WINDOW, STRIDE, HIDDEN, DIM, ATTENTION = 32, 4, 8, 16, 8
#: Rows of the n-gram table, n-gram lengths, documents a word needs to get its own vector, most such words.
GRAMS, LENGTHS, FEWEST, MOST_WORDS = 1 << 15, (3, 4, 5, 6), 4, 30_000
UPDATES, PASSES, BATCH, RATE = 420, 20, 16, 0.012
THRESHOLD = 0.7
#: Roots of likelihood ratios up to here are taken for chance; folds of the sample that judge one another's words.
CHANCE, FOLDS = 2.5, 5
#: Windows scored at once, words a worker remembers.
GROUP, REMEMBERED = 768, 300_000


def grams(bases: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the n-gram table for all n-grams of the marked words, and each one's word, ascending. Every word has some."""
    marked = [f"^{w}$".encode("utf-8", "surrogatepass") for w in bases]
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    text = np.frombuffer(b"".join(marked) + bytes(LENGTHS[-1]), np.uint8).astype(np.uint64)
    of = np.repeat(np.arange(len(marked)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(of))
    h, rows, owners, n = np.zeros(len(of), np.uint64), [], [], 0
    for n in range(1, LENGTHS[-1] + 1):
        h = (h + text[n - 1 : n - 1 + len(of)] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        if n in LENGTHS or n == 2:  # the shortest words are their own n-gram
            ok = left >= n if n > 2 else (left == 2) & (np.repeat(size, size) == 2)
            rows.append((h[ok] >> np.uint64(40)) % np.uint64(GRAMS))
            owners.append(of[ok])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(rows)[order].astype(np.int64), owner[order]


def words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def base(word: str) -> str:
    """Without the punctuation around it, if that leaves something."""
    return word.strip(".,;:!?|()[]{}\"'*_-") or word


def window_starts(n: int) -> list[int]:
    """The last window is moved back to end with the text."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def windows(codes: np.ndarray) -> np.ndarray:
    """All windows of a text, a row each; short texts are filled up with -1."""
    if len(codes) < WINDOW:
        return np.concatenate([codes, np.full(WINDOW - len(codes), -1, codes.dtype)])[None, :]
    return np.lib.stride_tricks.sliding_window_view(codes, WINDOW)[window_starts(len(codes))]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def sum_by(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids, ascending, and the sum of each one's rows."""
    order = np.argsort(ids, kind="stable")
    first = np.flatnonzero(np.diff(ids[order], prepend=ids[order[:1]] - 1))
    return ids[order[first]], np.add.reduceat(rows[order], first)


def evidence_of(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """How surely words go with a label: the signed root of the likelihood ratio of their counts of documents, less what chance gives, from -2 to 2."""
    n, share = np.maximum(toxic + clean, 1e-9), n_toxic / max(1, n_toxic + n_clean)
    part = lambda k, q: np.where(k > 0, k * np.log(np.maximum(k, 1e-9) / (n * max(q, 1e-9))), 0.0)
    root = np.sqrt(np.maximum(0.0, 2 * (part(toxic, share) + part(clean, 1 - share))))
    out = (np.sign(toxic / n - share) * np.clip(root - CHANCE, 0, 2)).astype(np.float32)
    out[0] = 0  # the place of all words that aren't known
    return out


class Network:
    """Arrays by name in ``p``; ``g`` tables hold gates' inputs: update, reset, candidate."""

    def __init__(self, n_words: int, seed: int = 7):
        r = np.random.default_rng(seed)
        new = lambda *s, scale=0.3: r.normal(0, scale, s).astype(np.float32)
        self.p = {"word": new(n_words + 1, DIM, scale=0.05), "gram": new(GRAMS, DIM, scale=0.05)}
        for d in "fb":
            self.p |= {f"in_{d}": new(DIM, 3 * HIDDEN), f"re_{d}": new(HIDDEN, 3 * HIDDEN), f"bias_{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"att": new(2 * HIDDEN, ATTENTION), "att_v": new(ATTENTION), "out": new(2 * HIDDEN), "out_b": np.zeros(1, np.float32)}

    def inputs(self, word_ids: np.ndarray, gram_ids: np.ndarray, gram_of: np.ndarray, evidence: np.ndarray) -> np.ndarray:
        """A vector for each distinct word; ``gram_of`` gives each n-gram's word, ascending; ``evidence`` of words enters the first component."""
        count = np.bincount(gram_of, minlength=len(word_ids)).astype(np.float32)
        first = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64)
        x = self.p["word"][word_ids] + np.add.reduceat(self.p["gram"][gram_ids], first) / count[:, None]
        x[:, 0] += evidence[word_ids]
        return x

    def gates(self, x: np.ndarray) -> list[np.ndarray]:
        """For both directions the gates' inputs of each distinct word, and of the filler, which keeps the state, as the last row."""
        keep = np.zeros((1, 3 * HIDDEN), np.float32)
        keep[:, :HIDDEN] = 30
        return [np.concatenate([x @ self.p[f"in_{d}"] + self.p[f"bias_{d}"], keep]).astype(np.float32) for d in "fb"]

    def run(self, gates: list[np.ndarray], codes: np.ndarray, cache: dict | None = None) -> np.ndarray:
        """The windows' logits."""
        n, steps = codes.shape
        states = np.empty((steps, n, 2 * HIDDEN), np.float32)
        for k, d in enumerate("fb"):
            h, re, own = np.zeros((n, HIDDEN), np.float32), self.p[f"re_{d}"], gates[k]
            re_zr, re_c = re[:, : 2 * HIDDEN].copy(), re[:, 2 * HIDDEN :].copy()
            kept = []
            for t in range(steps) if k == 0 else range(steps - 1, -1, -1):
                g = own.take(codes[:, t], axis=0, mode="wrap")
                zr = h @ re_zr
                zr += g[:, : 2 * HIDDEN]
                zr *= 0.5
                np.tanh(zr, out=zr)
                zr *= 0.5
                zr += 0.5
                z, r, un = zr[:, :HIDDEN], zr[:, HIDDEN:], h @ re_c
                c = r * un
                c += g[:, 2 * HIDDEN :]
                np.tanh(c, out=c)
                if cache is not None:
                    kept.append((t, h, z, r, un, c))
                h = h - c
                h *= z
                h += c
                states[t, :, k * HIDDEN : (k + 1) * HIDDEN] = h
            if cache is not None:
                cache[d] = kept
        q = np.tanh(states @ self.p["att"])
        e = np.where((codes >= 0).T, q @ self.p["att_v"], -1e9)
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        pooled = np.einsum("tn,tnh->nh", a, states)
        if cache is not None:
            cache |= {"states": states, "q": q, "a": a, "pooled": pooled}
        return pooled @ self.p["out"] + self.p["out_b"][0]

    def gradients(self, codes: np.ndarray, cache: dict, dlogit: np.ndarray) -> tuple[dict, list[np.ndarray], np.ndarray]:
        """Of all arrays but the two tables; of both directions' gates' inputs for the words that occur; these words."""
        p, states, q, a = self.p, cache["states"], cache["q"], cache["a"]
        grad = {"out": cache["pooled"].T @ dlogit, "out_b": dlogit.sum(keepdims=True)}
        dpooled = dlogit[:, None] * p["out"]
        dstates = a[:, :, None] * dpooled
        da = (dpooled * states).sum(2)
        de = a * (da - (a * da).sum(0))
        grad["att_v"] = (de[:, :, None] * q).sum((0, 1))
        dq = de[:, :, None] * p["att_v"] * (1 - q * q)
        grad["att"] = np.einsum("tni,tnj->ij", states, dq)
        dstates += dq @ p["att"].T
        dgates = []
        for k, d in enumerate("fb"):
            re, dre, steps = p[f"re_{d}"], np.zeros_like(p[f"re_{d}"]), np.empty((codes.shape[1], len(codes), 3 * HIDDEN), np.float32)
            dh = np.zeros((len(codes), HIDDEN), np.float32)
            for t, h, z, r, un, c in reversed(cache[d]):
                dh = dh + dstates[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                dc = dh * (1 - z) * (1 - c * c)
                dz = dh * (h - c) * z * (1 - z)
                dr = dc * un * r * (1 - r)
                du = np.concatenate([dz, dr, dc * r], 1)
                steps[t] = np.concatenate([dz, dr, dc], 1)
                dre += h.T @ du
                dh = dh * z + du @ re.T
            grad[f"re_{d}"] = dre
            dgates.append(sum_by(codes.T.ravel(), steps.reshape(-1, 3 * HIDDEN)))
        used = np.unique(codes)
        start = int(used[0] == -1)
        return grad, [g[start:] for _, g in dgates], used[start:]


class Vocabulary(dict):
    """Words' codes; ``new`` holds those not yet given to the network."""

    def __init__(self, known: dict[str, int]):
        self.known, self.new = known, []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n

    def codes(self, text: str | None) -> np.ndarray:
        own = words(text)
        return np.fromiter(map(self.__getitem__, own), np.int64, len(own))

    def learn(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the network's ``inputs``: the new words' own rows, their n-grams, and each n-gram's word."""
        bases = [base(w) for w in self.new]
        self.new = []
        return np.array([self.known.get(w, 0) for w in bases], np.int64), *grams(bases)


class Model:
    def __init__(self, network: Network | None, known: dict[str, int], evidence: np.ndarray | None = None, scale: float = 1.0, shift: float = 0.0):
        self.network, self.known, self.evidence, self.scale, self.shift = network, known, evidence, scale, shift

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """Each text's highest window; minus infinity where there's no word."""
        vocabulary, gates = self._remembered()
        codes = [vocabulary.codes(t) for t in texts]
        if vocabulary.new:
            more = self.network.gates(self.network.inputs(*vocabulary.learn(), self.evidence))
            gates = [np.concatenate([g[:-1], m]) for g, m in zip(gates, more, strict=True)] if gates else more
        self._memory = vocabulary, gates
        out, rows, of = np.full(len(texts), -np.inf), [], []

        def flush() -> None:
            if rows:
                np.maximum.at(out, np.concatenate(of), self.network.run(gates, np.concatenate(rows)))
                rows.clear()
                of.clear()

        waiting = 0
        for i, c in enumerate(codes):
            if not len(c):
                continue
            w = windows(c)
            for lo in range(0, len(w), GROUP):
                part = w[lo : lo + GROUP]
                rows.append(part)
                of.append(np.full(len(part), i))
                waiting += len(part)
                if waiting >= GROUP:
                    flush()
                    waiting = 0
        flush()
        return out

    def _remembered(self):
        memory = self.__dict__.get("_memory")
        if memory is None or len(memory[0]) > REMEMBERED:
            return Vocabulary(self.known), None
        return memory

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_memory"}

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.network is None:
            return np.zeros(len(texts))
        return np.nan_to_num(_sigmoid(self.scale * self.logits(texts) + self.shift)) * np.array([bool(words(t)) for t in texts])


def train(texts: list[str], labels: list[int], seed: int = 11) -> Model:
    """Deterministic for a given order of rows. A fifth of the rows only sets the threshold."""
    labels = np.array(labels)
    if len(set(labels.tolist())) < 2:
        return Model(None, {})
    seen: dict[str, int] = {}
    for t in texts:
        for w in set(map(base, words(t))):
            seen[w] = seen.get(w, 0) + 1
    often = sorted((w for w, n in seen.items() if n >= FEWEST), key=lambda w: (-seen[w], w))[:MOST_WORDS]
    known = {w: i + 1 for i, w in enumerate(often)}
    network, r = Network(len(known)), np.random.default_rng(seed)
    aside = np.arange(len(texts)) % 5 == 4
    if len(set(labels[~aside].tolist())) < 2 or len(texts) < 50:
        aside[:] = False
    vocabulary = Vocabulary(known)
    codes = [vocabulary.codes(t) for t in texts]
    bases = [base(w) for w in vocabulary]
    word_ids = np.array([known.get(w, 0) for w in bases], np.int64)
    vocabulary.clear()
    # n-grams of a few documents only would be learned by heart; their vectors are and stay zero
    count = np.zeros(GRAMS)
    distinct = list(seen)
    for lo in range(0, len(distinct), 20_000):
        some = distinct[lo : lo + 20_000]
        ids, of = grams(some)
        count += np.bincount(ids, np.array([seen[w] for w in some])[of], GRAMS)
    common = count >= FEWEST
    network.p["gram"][~common] = 0
    del seen, distinct
    groups = [np.array([i for i in np.flatnonzero(~aside & (labels == y)) if len(codes[i])], int) for y in (0, 1)]
    if not all(map(len, groups)):
        return Model(None, {})
    # a document learns from what the other folds' documents say of its words, since its own always agree with it
    fold = np.arange(len(texts)) % FOLDS
    seen_in = np.zeros((FOLDS, 2, len(known) + 1))
    for i in np.concatenate(groups):
        seen_in[fold[i], labels[i], np.unique(word_ids[codes[i]])] += 1
    sizes = np.array([[np.count_nonzero(fold[g] == k) for g in groups] for k in range(FOLDS)])
    judge = lambda rest: evidence_of(seen_in[rest, 1].sum(0), seen_in[rest, 0].sum(0), *sizes[rest].sum(0)[::-1])
    judged = [judge(np.arange(FOLDS) != k) for k in range(FOLDS)]
    own_fold = [[g[fold[g] == k] for g in groups] for k in range(FOLDS)]
    full = [k for k in range(FOLDS) if all(map(len, own_fold[k]))]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.p.items()}

    updates = min(UPDATES, max(60, PASSES * -(-min(map(len, groups)) // BATCH)))

    def adam(name: str, g: np.ndarray, rows: np.ndarray | None, step: int) -> None:
        m, v = moments[name]
        at = slice(None) if rows is None else rows
        m[at] = 0.9 * m[at] + 0.1 * g
        v[at] = 0.99 * v[at] + 0.01 * g * g
        rate = RATE * min(1, 2 * (1 - step / (updates + 1)))
        network.p[name][at] -= rate * (m[at] / (1 - 0.9 ** (step + 1))) / (np.sqrt(v[at] / (1 - 0.99 ** (step + 1))) + 1e-6)

    for step in range(updates):
        k = full[step % len(full)] if full else 0
        docs = np.concatenate([r.choice(g, min(BATCH, len(g)), replace=False) for g in (own_fold[k] if full else groups)])
        every = [windows(codes[i]) for i in docs]
        rows = np.concatenate(every)
        used, local = np.unique(rows, return_inverse=True)
        local = local.reshape(rows.shape) - (used[0] == -1)
        used = used[used >= 0]
        grams_used, owner = grams([bases[i] for i in used])
        length, words_used = np.bincount(owner, minlength=len(used)), word_ids[used].copy()
        words_used[r.random(len(used)) < 0.3] = 0  # now and then only the characters speak
        x = network.inputs(words_used, grams_used, owner, judged[k])
        gates = network.gates(x)
        logit = network.run(gates, local)
        chosen, target, at = [], [], 0
        for i, w in zip(docs, every, strict=True):
            best = at + np.argsort(-logit[at : at + len(w)], kind="stable")[: 2 if labels[i] and len(w) > 2 else 1]
            chosen += best.tolist()
            target += [labels[i]] * len(best)
            at += len(w)
        cache: dict = {}
        part = local[chosen]
        out = network.run(gates, part, cache)
        dlogit = ((_sigmoid(out) - np.array(target)) / len(chosen)).astype(np.float32)
        grad, dgates, touched = network.gradients(part, cache, dlogit)
        dx = np.zeros((len(touched), DIM), np.float32)
        for d, dg in zip("fb", dgates, strict=True):
            grad[f"in_{d}"], grad[f"bias_{d}"] = x[touched].T @ dg, dg.sum(0)
            dx += dg @ network.p[f"in_{d}"].T
        at = np.full(len(used), -1)
        at[touched] = np.arange(len(touched))
        mine = (at[owner] >= 0) & common[grams_used]
        adam("gram", *reversed(sum_by(grams_used[mine], (dx / length[touched, None])[at[owner[mine]]])), step)
        own = words_used[touched] > 0
        if own.any():
            adam("word", *reversed(sum_by(words_used[touched][own], dx[own])), step)
        for name, g in grad.items():
            adam(name, g.astype(np.float32), None, step)
    model = Model(network, known, judge(np.ones(FOLDS, bool)))
    held = aside if aside.any() and labels[aside].any() else np.ones(len(texts), bool)
    own = [t for t, h in zip(texts, held, strict=True) if h]
    logit = np.concatenate([model.logits(own[i : i + 200]) for i in range(0, len(own), 200)])
    model.__dict__.pop("_memory", None)
    y = labels[held]
    model.shift = float(np.log(THRESHOLD / (1 - THRESHOLD))) - best_cut(logit, y)
    return model


def best_cut(logit: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest stretch of cuts with the highest F1."""
    finite = np.isfinite(logit)
    values = np.unique(logit[finite])
    cuts = np.concatenate([[values[0] - 1], (values[1:] + values[:-1]) / 2, [values[-1] + 1]])
    f1 = []
    for c in cuts:
        hit = logit >= c
        f1.append(2 * np.count_nonzero(hit & (y == 1)) / max(1, np.count_nonzero(hit) + np.count_nonzero(y == 1)))
    best = np.flatnonzero(np.array(f1) >= max(f1) - 1e-12)
    edges = np.concatenate([[values[0] - 2], values, [values[-1] + 2]])
    widths = [edges[i + 1] - edges[i] for i in best]
    i = best[int(np.argmax(widths))]
    return float((edges[i] + edges[i + 1]) / 2)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> Model:
    """Learns from a bounded sample of the labelled rows that aren't held out; the sample is chosen by hash of the key."""
    known = labels.filter(~held_out(F.col(key)) & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(F.col(label)).alias("_toxic"))
    short = docs.select(F.col(key).alias("_doc"), F.col(text).alias("_text")).filter(F.octet_length("_text") <= MOST_BYTES)
    chosen = [known.filter(F.col("_toxic") == y).orderBy(F.xxhash64("_key"), "_key").limit(n) for y, n in ((1, MOST_TOXIC), (0, MOST_CLEAN))]
    sample = short.join(F.broadcast(chosen[0].unionByName(chosen[1])), F.col("_doc") == F.col("_key"))  # at most MOST_TOXIC + MOST_CLEAN keys
    order = [F.xxhash64("_key"), F.col("_key")]
    so_far = F.sum(F.octet_length("_text")).over(Window.partitionBy("_toxic").orderBy(*order))  # over the sample's rows
    one = sample.groupBy("_key", "_toxic").agg(F.min("_text").alias("_text")).withColumn("_bytes", so_far).filter(F.col("_bytes") <= SAMPLE_BYTES).orderBy(*order).collect()
    return train([r["_text"] for r in one], [r["_toxic"] for r in one])


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: key, ``held_out``, ``score``, ``predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the size of the tables above

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = _here(shared)
        for texts in batches:
            yield pd.Series(np.concatenate([m.scores(texts.iloc[i : i + 256].tolist()) for i in range(0, len(texts), 256)] or [np.empty(0)]))

    scored = docs.select(key, held_out(F.col(key)).alias("held_out"), of(F.col(text)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


@lru_cache(maxsize=1)
def _here(shared) -> Model:
    return shared.value
