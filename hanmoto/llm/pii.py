"""Personal data: base patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans they miss.

The base patterns (email, ip, card, phone) are exact. Their matches in a bounded sample of documents are the labelled spans from which
the network learns, half of them written in another way (``name at host dot org``, a phone number without ``+``, a card number with dots), amid
numbers that are nobody's. It runs over all characters of all texts, in windows of WINDOW characters with OVERLAP in common. Gates are piecewise linear.
A window is decoded by Viterbi unless the best stretch of each kind, found in one sweep, scores no more than no span at all.
Then a text's spans are reconciled as a whole: those cut by a window's edge are joined with what the next window
saw, those that fail the kind's own check (Luhn, parts up to 255, digits) or that meet a base span go, and of those that overlap the
set with the largest total score stays.

Defined results: a null or empty text has no spans; repeated rows and ids are texts of their own; without base spans in the sample there is
nothing to learn from and base spans are all; an empty table gives an empty table; texts are taken whole whatever their length;
other columns are ignored. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")
#: Documents of the training sample, with and without marks of personal data, and bytes that one of them may have.
MOST_MARKED, MOST_OTHER, MOST_BYTES = 600, 150, 50_000
#: Characters of a window and those it shares with the next, characters run through the network at once, score that a span needs, texts taken together.
WINDOW, OVERLAP, GROUP, MARGIN, ROWS = 512, 64, 1 << 20, 3.0, 1024
HIDDEN, LENGTH, BATCH, UPDATES, RATE, SEED = 8, 96, 64, 700, 0.02, 7
TAGS = len(KINDS) + 1

_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?+[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = re.compile("[0-9]+")


# Base patterns


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def byte_parts(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from their ``@``, so that long runs of letters take linear time."""
    free = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        free = found.end() if found else at + 1
        if found:
            yield start, free
        at = max(free, at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if byte_parts(m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15]
    return sorted(out)


# Symbols


@lru_cache(maxsize=1)
def _table() -> np.ndarray:
    """Letters without case, one symbol for all digits, one each for ASCII marks, space and line end, and one each for other letters, controls and the rest. 0 is no character."""
    table = np.full(0x10001, 64, np.uint8)
    for i in range(0x10000):
        if unicodedata.category(chr(i))[0] in "LM":
            table[i] = 63
    table[:128] = 62
    marks = [c for c in range(33, 127) if not chr(c).isalnum()]
    table[marks] = 28 + np.arange(len(marks))
    table[48:58], table[32], table[10] = 27, 60, 61
    table[65:91] = table[97:123] = 1 + np.arange(26)
    return table


SYMBOLS = 65


def symbols(text: str) -> np.ndarray:
    return _table()[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), 0x10000)]


# Training


def renamed(kind: int, s: str, names: list[str], r: np.random.Generator) -> str:
    """Another datum of the same kind: other digits, in an address other names and another ending."""
    pick = lambda *options: options[int(r.integers(len(options)))]
    name = lambda: names[int(r.integers(len(names)))]
    if kind == 0:
        local = name() + pick("", ".", "_", "-", "+") + pick("", name(), str(r.integers(0, 2000)))
        return f"{local.strip('._-+')}@{name()}{pick('', '-' + name(), str(r.integers(0, 99)))}{pick('', '.' + name())}.{pick('com', 'org', 'net', 'de', 'fr', 'es', 'co.uk', 'io', 'edu', 'info')}"
    if kind == 1:
        return ".".join(str(int(v)) for v in r.integers(0, 256, 4))
    return re.sub("[0-9]", lambda m: str(r.integers(0, 10)), s)


def variant(kind: int, s: str, r: np.random.Generator) -> str:
    """The same datum as someone else might write it."""
    pick = lambda *options: options[int(r.integers(len(options)))]
    digits = "".join(_DIGITS.findall(s))
    if kind == 0:
        local, _, domain = s.rpartition("@")
        at, dot = pick((" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "."), (" @ ", "."), (" AT ", " DOT "), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" (at) ", "."), (" [at] ", "."))
        return (local.replace(".", dot) if " " in dot else local) + at + domain.replace(".", dot)
    if kind == 1:
        return pick(" . ", "[.]", "(.)", " dot ").join(s.split("."))
    if kind == 2:
        gap = pick(".", "/", "_", " - ", "  ", ". ")
        return gap.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    tail = digits[-10:]
    a, b, c = tail[:3], tail[3:6], tail[6:]
    return pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"1 ({a}) {b}-{c}", f"001 {a} {b} {c}", f"({a}){b}-{c}", f"1-{a}-{b}-{c}")


def nobodys(r: np.random.Generator) -> str:
    """Numbers and words of the same look that are no personal data."""
    n = lambda a, b: str(r.integers(a, b))
    options = (
        lambda: f"{n(1900, 2100)}-{n(1, 13).zfill(2)}-{n(1, 32).zfill(2)}",
        lambda: f"{n(1, 32)}.{n(1, 13)}.{n(1900, 2100)}",
        lambda: f"{n(1, 13)}/{n(1, 32)}/{n(1900, 2100)} {n(0, 24)}:{n(10, 60)}:{n(10, 60)}",
        lambda: f"v{n(0, 9)}.{n(0, 20)}.{n(0, 20)}",
        lambda: f"{n(1, 999)},{n(100, 999)},{n(100, 999)}.{n(10, 99)}",
        lambda: f"{n(1900, 2000)}-{n(2000, 2100)}",
        lambda: n(1, 10 ** int(r.integers(1, 18))),
        lambda: "".join("0123456789abcdef"[i] for i in r.integers(0, 16, int(r.integers(8, 41)))),
        lambda: f"look at the dot {n(1, 99)}",
        lambda: f"at {n(1, 12)} o'clock",
        lambda: f"@ {n(1, 99)}",
        lambda: f"#{n(1, 9999)} of {n(1, 9999)}",
        lambda: f"{n(1, 9)} + {n(1, 9)} = {n(1, 19)}",
        lambda: f"({n(1, 999)}) {n(1, 99)}",
    )
    return options[int(r.integers(len(options)))]()


def examples(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and tags of windows of LENGTH characters: each labelled span as it is and in other ways, and windows without any."""
    r = np.random.default_rng(SEED)
    rows = []
    names = sorted({w.lower() for t in texts for w in re.findall("[A-Za-z]{2,9}", t[:2000])}) or ["a"]

    def add(parts: list[tuple[str, int]], shift: int) -> None:
        text = "".join(p for p, _ in parts)[shift : shift + LENGTH]
        tag = np.repeat([t for _, t in parts], [len(p) for p, _ in parts])[shift : shift + LENGTH]
        rows.append((np.pad(symbols(text), (0, LENGTH - len(text))), np.pad(tag, (0, LENGTH - len(tag)))))

    for text in texts:
        spans = base_spans(text)
        for start, kind, end in spans:
            for way in range(4):
                lo, hi = max(0, start - LENGTH), end + LENGTH
                shown = renamed(kind, text[start:end], names, r) if way > 1 else text[start:end]
                if way % 2:
                    shown = variant(kind, shown, r)
                clear = lambda s: re.sub("[0-9@+]", "x", s)  # noqa: E731  (other data near by is another example's)
                left, right = clear(text[lo:start]), clear(text[end:hi])
                if r.random() < 0.4:
                    left = left[: -min(len(left), 20)] + " " + nobodys(r) + " "
                    right = " " + nobodys(r) + " " + right
                add([(left, 0), (shown, kind + 1), (right, 0)], max(0, len(left) - int(r.integers(0, LENGTH - 20))))
        for _ in range(3):
            at = int(r.integers(0, max(1, len(text) - LENGTH)))
            if not any(s < at + LENGTH and e > at for s, _, e in spans):
                cut = text[at : at + LENGTH // 2]
                add([(cut, 0), (" " + nobodys(r) + " ", 0), (text[at + LENGTH // 2 : at + LENGTH], 0)], 0)
    x, y = (np.array([q[k] for q in rows], np.int64).reshape(-1, LENGTH) for k in (0, 1))
    return x, y


def _run(p: dict, x: np.ndarray) -> tuple[np.ndarray, list]:
    """Emissions (rows, places, tags) in both directions, and what the gradient needs."""
    n, length = x.shape
    seen, places = np.stack([x, x[:, ::-1]]), []
    h = c = np.zeros((2, n, HIDDEN), p["u"].dtype)
    em = np.zeros((2, n, length, TAGS), p["u"].dtype)
    for t in range(length):
        z = h @ p["u"] + np.stack([p["in"][k][seen[k, :, t]] for k in (0, 1)])
        g = np.concatenate([np.clip(z[..., : 3 * HIDDEN], 0, 1), np.clip(z[..., 3 * HIDDEN :], -1, 1)], 2)
        i, f, o, new = np.split(g, 4, 2)
        before, was = c, h
        c = f * before + i * new
        h = o * np.clip(c, -1, 1)
        em[:, :, t] = h @ p["out"]
        places.append((was, before, z, g, c, h))
    return em[0] + em[1][:, ::-1] + p["bias"], places


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(a - m).sum(axis))


def crf_gradient(em: np.ndarray, move: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of the tags, and its gradients by emissions and transitions."""
    n, length, _ = em.shape
    a, b = np.zeros_like(em), np.zeros_like(em)
    a[:, 0] = em[:, 0]
    for t in range(1, length):
        a[:, t] = _lse(a[:, t - 1][:, :, None] + move, 1) + em[:, t]
    for t in range(length - 2, -1, -1):
        b[:, t] = _lse((b[:, t + 1] + em[:, t + 1])[:, None] + move, 2)
    z = _lse(a[:, -1], 1)
    by_place = np.exp(a + b - z[:, None, None])
    both = np.exp(a[:, :-1, :, None] + move + (b + em)[:, 1:, None, :] - z[:, None, None, None]).sum((0, 1))
    rows, at = np.arange(n)[:, None], np.arange(length)
    by_place[rows, at, y] -= 1
    np.subtract.at(both, (y[:, :-1], y[:, 1:]), 1)
    gold = em[rows, at, y].sum(1) + move[y[:, :-1], y[:, 1:]].sum(1)
    return float((z - gold).mean()), by_place / n, both / n


def _gradient(p: dict, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    em, places = _run(p, x)
    loss, d_em, d_move = crf_gradient(em, p["move"], y)
    seen, both = np.stack([x, x[:, ::-1]]), np.stack([d_em, d_em[:, ::-1]])
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["move"], g["bias"] = d_move, d_em.sum((0, 1))
    dh = dc = np.zeros((2, len(x), HIDDEN), p["u"].dtype)
    for t in range(x.shape[1] - 1, -1, -1):
        was, before, z, gates, c, h = places[t]
        i, f, o, new = np.split(gates, 4, 2)
        g["out"] += h.transpose(0, 2, 1) @ both[:, :, t]
        dh = dh + both[:, :, t] @ p["out"].transpose(0, 2, 1)
        dc = dc + dh * o * (np.abs(c) < 1)
        dz = np.concatenate([dc * new, dc * before, dh * np.clip(c, -1, 1), dc * i], 2)
        low = np.r_[np.zeros(3 * HIDDEN), np.full(HIDDEN, -1)]
        dz = dz * ((z > low) & (z < 1))
        g["u"] += was.transpose(0, 2, 1) @ dz
        for k in (0, 1):
            np.add.at(g["in"][k], seen[k, :, t], dz[k])
        dh, dc = dz @ p["u"].transpose(0, 2, 1), dc * f
    return loss, g


def train(texts: list[str], updates: int = UPDATES) -> dict | None:
    x, y = examples(texts)
    if not y.any():
        return None
    r = np.random.default_rng(SEED)
    draw = lambda *s: r.normal(size=s).astype(np.float32)
    p = {"in": 0.2 * draw(2, SYMBOLS, 4 * HIDDEN), "u": 0.2 * draw(2, HIDDEN, 4 * HIDDEN), "out": 0.3 * draw(2, HIDDEN, TAGS), "bias": np.r_[1.0, np.zeros(TAGS - 1)].astype(np.float32), "move": (np.eye(TAGS) * 2).astype(np.float32)}
    p["in"][..., : HIDDEN] += 0.5
    p["in"][..., HIDDEN : 2 * HIDDEN] += 0.8
    p["in"][..., 2 * HIDDEN : 3 * HIDDEN] += 0.5
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    kind = y.max(1)
    groups = [np.flatnonzero(kind == k) for k in range(TAGS) if (kind == k).any()]
    for step in range(1, updates + 1):
        rows = np.concatenate([r.choice(g, BATCH // len(groups)) for g in groups])  # as many of each kind
        _, g = _gradient(p, x[rows], y[rows])
        norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
        rate = RATE * min(1.0, 2 * (1 - step / (updates + 1)))
        for k, v in g.items():
            v = v * min(1.0, 5 / norm)
            first[k] = 0.9 * first[k] + 0.1 * v
            second[k] = 0.99 * second[k] + 0.01 * v * v
            p[k] = (p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return p


#: What a text with personal data holds, unless it holds an at sign.
MARKED = r"\+[0-9]|[0-9](?:[0-9]{12}|\.[0-9]+\.[0-9]|[0-9]{3}[ -][0-9]{4})"


def fit(docs: DataFrame, text: str = "text") -> dict | None:
    """The network, from the base spans of a bounded sample that depends on the texts alone: distinct ones with the least hashes, up to a bound set by their number."""
    own = docs.select(F.col(text).alias("t")).filter((F.octet_length("t") <= MOST_BYTES) & (F.length("t") > 0))
    marked = F.col("t").contains("@") | F.col("t").rlike(MARKED)
    own = own.select("t", F.xxhash64("t").alias("h"), marked.alias("m"))
    most, there = {True: MOST_MARKED, False: MOST_OTHER}, {q["m"]: q["n"] for q in own.groupBy("m").agg(F.approx_count_distinct("h").alias("n")).collect()}
    bound = {m: min((1 << 63) - 1, int(-(1 << 63) + (1 << 64) * 1.5 * most[m] / max(1, n))) for m, n in there.items()}
    near = F.when(F.col("m"), F.lit(bound.get(True, 0))).otherwise(F.lit(bound.get(False, 0)))
    found = sorted((q["h"], q["t"], q["m"]) for q in own.filter((F.col("h") <= max(bound.values(), default=0)) & (F.col("h") <= near)).distinct().collect())  # most rows need no search for marks
    return train([t for m, n in most.items() for t in [t for _, t, own in found if own == m][:n]])


# Decoding


class Decoder:
    """Runs windows through the network. What stands before and after a window counts as empty, and two kinds never touch, so that a path is a set of spans."""

    def __init__(self, p: dict):
        self.inputs = p["in"]
        self.u, self.out = np.ascontiguousarray(p["u"].transpose(0, 2, 1)), np.ascontiguousarray(p["out"].transpose(0, 2, 1))
        self.bias = p["bias"]
        move = (p["move"] - p["move"][0, 0]).astype(np.float32)
        self.stay, self.turn = move.diagonal()[1:], move[0, 1:] + move[1:, 0]
        self.move = np.where(np.eye(TAGS, dtype=bool) | (np.arange(TAGS) == 0) | (np.arange(TAGS) == 0)[:, None], move, np.float32(-1e9))

    def emissions(self, windows: list[np.ndarray]) -> Iterator[tuple[list[int], np.ndarray]]:
        """Numbers of windows of one length and their emissions (places, tags, windows) less those of the empty tag, where some span scores over 0."""
        order = sorted(range(len(windows)), key=lambda i: -len(windows[i]))
        size = np.array([len(windows[i]) for i in order])
        longest = int(size[0])
        seen = np.zeros((2, longest, len(order)), np.intp)
        for k, i in enumerate(order):
            w = windows[i]
            seen[0, : len(w), k], seen[1, : len(w), k] = w, w[::-1]
        em = np.zeros((2, longest, TAGS, len(order)), np.float32)
        n = len(order)
        h, c = (np.zeros((2, HIDDEN, n), np.float32) for _ in range(2))
        for t in range(longest):
            m = int(np.searchsorted(-size, -t, "left"))  # windows longer than t
            if m < n:
                h, c, n = np.ascontiguousarray(h[..., :m]), np.ascontiguousarray(c[..., :m]), m
            z = np.matmul(self.u, h)
            for k in (0, 1):
                z[k] += np.take(self.inputs[k], seen[k, t, :m], axis=0).T
            sure, new = z[:, : 3 * HIDDEN], z[:, 3 * HIDDEN :]
            np.clip(sure, 0, 1, out=sure)
            np.clip(new, -1, 1, out=new)
            c *= sure[:, HIDDEN : 2 * HIDDEN]
            c += sure[:, :HIDDEN] * new
            h = sure[:, 2 * HIDDEN :] * np.clip(c, -1, 1)
            em[:, t, :, :m] = np.matmul(self.out, h)
        em[0] += self.bias[:, None]
        em -= em[:, :, :1].copy()
        for length in np.unique(size):
            at = np.flatnonzero(size == length)
            at = slice(int(at[0]), int(at[-1]) + 1)
            both = em[0][:length, :, at] + em[1][:length, :, at][::-1]
            run, best = np.zeros((2, TAGS - 1, both.shape[2]), np.float32)
            for v in both[:, 1:]:
                run = np.maximum(run, 0) + (v + self.stay[:, None])
                np.maximum(best, run, out=best)
            open_ = np.flatnonzero((best + (self.turn - self.stay)[:, None] > 0).any(0))
            if len(open_):
                yield [order[at.start + k] for k in open_.tolist()], both[:, :, open_]

    def paths(self, em: np.ndarray) -> np.ndarray:
        """The best tags (windows, places)."""
        length, _, n = em.shape
        em, back = np.ascontiguousarray(em.transpose(0, 2, 1)), np.zeros((length, n, TAGS), np.int8)
        score = em[0] + self.move[0]
        for t in range(1, length):
            step = score[:, :, None] + self.move
            back[t] = step.argmax(1)
            score = step.max(1) + em[t]
        tags = np.zeros((n, length), np.int8)
        tags[:, -1] = (score + self.move[:, 0]).argmax(1)
        for t in range(length - 1, 0, -1):
            tags[:, t - 1] = back[t, np.arange(n), tags[:, t]]
        return tags

    def spans(self, em: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
        """(window, start, end, kind, score against the path without it)."""
        for w, tags in enumerate(self.paths(em)):
            edges = np.flatnonzero(np.diff(np.r_[-1, tags, -1]))
            for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if k := int(tags[s]):
                    yield w, s, e, k - 1, float(em[s:e, k, w].sum() + self.turn[k - 1] + (e - s - 1) * self.stay[k - 1])

    def candidates(self, texts: list[str]) -> list[list[tuple[int, int, int, float, bool, bool]]]:
        """For each text (start, end, kind, score, cut at the start, cut at the end), from all its windows."""
        found: list[list] = [[] for _ in texts]
        windows, places, size = [], [], 0

        def flush() -> None:
            nonlocal size
            for numbers, em in self.emissions(windows) if windows else ():
                for w, s, e, k, score in self.spans(em):
                    i, at, last = places[numbers[w]]
                    found[i].append((at + s, at + e, k, score, s == 0 and at > 0, e == len(em) and not last))
            windows.clear(), places.clear()
            size = 0

        for i, text in enumerate(texts):
            code = symbols(text)
            for at in range(0, max(1, len(code) - OVERLAP), WINDOW - OVERLAP) if len(code) else ():
                windows.append(code[at : at + WINDOW])
                places.append((i, at, at + WINDOW >= len(code)))
                size += len(windows[-1])
                if size >= GROUP:
                    flush()
        flush()
        return found


def plausible(kind: int, s: str) -> bool:
    """The kind's own check of a span."""
    digits = _DIGITS.findall(s)
    if kind == 0:
        return bool(re.search(r"@|\b[aA][tT]\b", s) and re.search(r"\.|\b[dD][oO][tT]\b", s) and re.match("[A-Za-z0-9]", s) and re.search("[A-Za-z]{2}$", s))
    if kind == 1:
        return len(digits) == 4 and byte_parts(digits)
    whole = "".join(digits)
    return 14 <= len(whole) <= 19 and luhn(whole) if kind == 2 else 10 <= len(whole) <= 15


def reconcile(text: str, base: list[tuple[int, int, int]], found: list[tuple[int, int, int, float, bool, bool]]) -> list[tuple[int, int, int]]:
    """Base spans and what the windows add to them, as (start, kind, end), sorted."""
    joined: list[list] = []
    for s, e, k, score, cut_before, cut_after in sorted(found):
        if joined and joined[-1][2] == k and s <= joined[-1][1] and (cut_before or joined[-1][4]):
            last = joined[-1]
            last[1], last[3], last[4] = max(e, last[1]), max(score, last[3]), cut_after if e >= last[1] else last[4]
        else:
            joined.append([s, e, k, score, cut_after])
    taken = sorted({(s, e) for s, _, e in base})
    starts, reach = [s for s, _ in taken], []
    for _, e in taken:
        reach.append(max(e, reach[-1] if reach else 0))
    good = []
    for s, e, k, score, _ in joined:
        own = text[s:e]
        lead, tail = (re.search(p, own) for p in (r"^[^A-Za-z0-9(+]*", r"[^A-Za-z0-9]*$"))
        s, e = s + lead.end(), e - (tail.end() - tail.start())
        i = bisect_right(starts, e - 1)
        if s < e and score >= MARGIN and plausible(k, text[s:e]) and not (i and reach[i - 1] > s):
            good.append((e, s, k, score))
    good.sort()
    ends, best, choice = [g[0] for g in good], [0.0], []
    for n, (_, s, _, score) in enumerate(good):
        before = bisect_right(ends, s, 0, n)
        choice.append(before if best[before] + score > best[n] else -1)
        best.append(max(best[n], best[before] + score))
    out, n = list(base), len(good)
    while n:
        if choice[n - 1] >= 0:
            e, s, k, _ = good[n - 1]
            out.append((s, k, e))
            n = choice[n - 1]
        else:
            n -= 1
    return sorted(out)


_SPANS = "array<struct<kind:string,start:long,end:long>>"


def find_spans(docs: DataFrame, model: dict | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: ``doc_id, base`` (spans of the base patterns) and ``spans`` (these and what the network adds), by start, then kind."""
    own = docs.select(F.col(key), F.col(text))
    schema = T.StructType([T.StructField(key, own.schema[0].dataType), *T._parse_datatype_string(f"base {_SPANS}, spans {_SPANS}").fields])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = None if model is None else Decoder(model)
        shown = lambda rows: pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in q] for q in rows], kind)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                b = batch.slice(lo, ROWS)
                texts = [t or "" for t in b.column(1).to_pylist()]
                base = [base_spans(t) for t in texts]
                found = decoder.candidates(texts) if decoder else [[]] * len(texts)
                yield pa.record_batch([b.column(0), shown(base), shown([reconcile(*q) if q[2] else q[1] for q in zip(texts, base, found, strict=True)])], [key, "base", "spans"])

    return own.mapInArrow(f, schema)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """``doc_id``, how many base spans of each kind, the hash of the base spans, and all spans, as text."""
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(key, *map(count, KINDS), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))
