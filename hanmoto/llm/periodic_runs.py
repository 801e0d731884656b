"""Periodic runs of words, from Lyndon arrays with reused extensions (after Ellert and Fischer).

A run is a maximal stretch of words with a smallest period that fits in it at least twice. Words are letters of an ordered alphabet and are only
ever compared: no suffix structure is built and nothing of the text is hashed. (Words get numbers by first occurrence, any order would do.)

The Lyndon array gives for each place the next place whose suffix is smaller; the stretch up to there is the longest Lyndon word that begins there.
Places are taken from left to right, with the chain of previous smaller suffixes as a stack. How far two suffixes agree follows from
how far their neighbours in the chain agree, unless both are equal, and only then words are compared. The stretch that has been compared furthest
to the right equals an earlier one; as long as a place's own comparisons end inside it, its results are those of its earlier copy, and
comparisons that reach its end go on from there. So every comparison of two equal words moves that end, and the array takes linear time.

Every run has a Lyndon word of its period's length as root, in the order of words or in its reverse. So a run is found from its first root: to the right
the agreement is known from the array, to the left words are compared, fewer than the period of them.

Defined results: a null, empty or blank text has no runs and collapses to nothing; repeated rows and ids are texts of their own; a text of any length is
one task's row, with about 200 bytes a word; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import WORD, words

#: Words of a run at least; words from which arrays of fixed width hold the numbers.
FEWEST, MANY = 12, 1 << 18
_RUNS = "array<struct<start:long,length:long,period:long>>"
_word = re.compile(WORD)


def lyndon(t) -> tuple:
    """For each place the next smaller suffix (the length of ``t`` if there is none), and how many numbers the two have in common."""
    n = len(t)
    fill = (lambda v: array("q", [v]) * n) if n > MANY else (lambda v: [v] * n)
    nss, nlce, pss, plce, most = fill(n), fill(0), fill(-1), fill(0), fill(0)
    a = b = end = 0  # t[a : a + end - b] equals t[b : end], the match that ends furthest right
    for i in range(1, n):
        j = i - 1
        if i < end:
            d, left = b - a, end - i
            k = i - d
            if most[k] < left:  # everything was decided inside the match, and so it is here
                last = pss[k] + d
                while j != last:
                    nss[j], nlce[j] = i, nlce[j - d]
                    j = pss[j]
                pss[i], plce[i], most[i] = last, plce[k], most[k]
                continue
            last = pss[k] + d
            while (common := plce[k] if j == last else nlce[j - d]) < left:
                nss[j], nlce[j] = i, common
                j = pss[j]
            common = left
        else:
            common = 0
        at = i + common
        while at < n and t[j + common] == t[at]:
            common += 1
            at += 1
        best, of = common, j
        while at == n or t[j + common] > t[at]:  # the suffix at j is larger
            nss[j], nlce[j] = i, common
            before, j = plce[j], pss[j]
            if j < 0:
                break
            if before < common:
                common = before
                break
            if before == common:
                while at < n and t[j + common] == t[at]:
                    common += 1
                    at += 1
                if common > best:
                    best, of = common, j
        pss[i], plce[i], most[i] = j, common if j >= 0 else 0, best
        a, b, end = of, i, i + best
    return nss, nlce


def runs(t, fewest: int = FEWEST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least so many numbers, by start, then period."""
    n = len(t)
    if n < max(2, fewest):
        return []
    code, found = np.array(t, np.int64), set()
    here = np.arange(n)
    for order in (t, [-x for x in t] if n <= MANY else array("q", (-x for x in t))):
        nss, nlce = (np.array(x, np.int64) for x in lyndon(order))
        period = nss - here
        before = np.maximum(here - period, 0)
        again = (here >= period) & (nss[before] == here) & (nlce[before] >= period)  # the same run has a root before
        need = np.maximum(np.maximum(period - nlce, fewest - period - nlce), 0)  # words to the left that make it a run
        open_ = np.flatnonzero((nlce > 0) & ~again & (need < period) & (need <= here))
        far = open_ - need[open_]
        open_ = open_[(code[far] == code[far + period[open_]])]
        for i, p, right in zip(open_.tolist(), period[open_].tolist(), nlce[open_].tolist(), strict=True):
            start, step = i, 16
            while start > 0 and i - start < p:
                lo = max(0, start - step, i - p)
                differ = np.flatnonzero(code[lo:start] != code[lo + p : start + p])
                if len(differ):
                    start = lo + int(differ[-1]) + 1
                    break
                start, step = lo, step * 4
            length = i + p + right - start
            if length >= max(fewest, 2 * p):
                found.add((start, length, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def repeated(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words some run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) > 0


def numbered(tokens: list[str]) -> list[int] | array:
    codes: dict[str, int] = {}
    numbers = (codes.setdefault(w, len(codes)) for w in tokens)
    out = array("q", numbers) if len(tokens) > MANY else list(numbers)
    return out if len(tokens) - len(codes) >= FEWEST // 2 else []  # at least so many words of a run came before


def find_and_collapse(text: str | None) -> tuple[list[tuple[int, int, int]], str]:
    tokens = _word.findall(text or "")
    found = runs(numbered(tokens))
    if found:
        gone = repeated(len(tokens), found)
        tokens = [w for w, g in zip(tokens, gone.tolist(), strict=True) if not g]
    return found, " ".join(tokens)


def find_runs(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: ``doc_id, runs`` (word number, length, period) and ``collapsed``, the words that no run repeats, with one blank between."""
    own = docs.select(F.col(key), F.col(text))
    schema = T.StructType([T.StructField(key, own.schema[0].dataType), *T._parse_datatype_string(f"runs {_RUNS}, collapsed string").fields])
    kind = to_arrow_type(schema["runs"].dataType)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                b = batch.slice(lo, 256)
                out = [find_and_collapse(t) for t in b.column(1).to_pylist()]
                found = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in o[0]] for o in out], kind)
                yield pa.record_batch([b.column(0), found, pa.array([o[1] for o in out], pa.string())], [key, "runs", "collapsed"])

    return own.mapInArrow(f, schema)


def with_periods(text: Column, key: Column) -> Column:
    """The text, but for ids whose checksum ends in 0: there the words from some place on repeat the first of them, which makes runs to be found."""
    h = F.crc32(key.cast("string"))
    g = F.floor(h / 10)

    def edited(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p))), " ")

    whole = F.element_at(F.transform(F.array(words(text)), lambda w: F.when(F.size(w) > 0, edited(w)).otherwise("")), 1)
    return F.when(h % 10 == 0, whole).otherwise(text)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """``doc_id, n_runs``, the longest run (the first, of the smaller period) and hashes of all runs and of what is left."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    own = found.select(key, F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length = -F.col("b.l")
    return own.select(key, "n_runs", F.col("b.s").alias("start"), length.alias("length"), F.col("b.p").alias("period"), F.floor(1000 * length / F.col("b.p")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
