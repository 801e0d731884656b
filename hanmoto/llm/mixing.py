"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target in words; each of its documents is to be taken target / size times. The whole part of that number is taken
as it is; the fractional parts are rounded together: a document and the rest of its slice exchange word mass at random until one of them
is whole, so that the source's words and each document's expectation are kept. Slices of a source are rounded apart; the one
document that is left fractional in each goes up a reduction tree, and only the last of a source is rounded alone. Large documents come
first at every node, so what is left fractional is small: a source misses its target by less than the size of that last document.

Rows that are equal in id, source and text are counted before they are rounded: their number times the fraction has a whole part, which so
many of them get, and only the rest of it is rounded, as one document.

Defined results: a null source is a source, last in order; a null or empty text has size 0 and is never taken; repeated ids and rows are
documents of their own; an empty table gives an empty table; rows that tie in everything are interchangeable. Random numbers come
from the slice's name, and slices from the rows' content, so that reruns and retries agree.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, global_rank, materialize, running_total, scratch

WEIGHTS = (5, 2, 1)
#: Words of the mix, as a share of all words.
SHARE = 1.5
#: No source may be taken more often than so many times.
MOST = 2.0
#: Rows that are rounded together by one call, and slices that one node of the tree combines.
SLICE, FAN = 1_000, 64
#: A fraction this near to 0 or 1 is that.
EDGE = 1e-9


def pivot(p: np.ndarray, size: np.ndarray, r: np.random.Generator) -> np.ndarray:
    """Rounds ``p``; all but at most one result are 0 or 1, and sum(p * size) and each expectation stay. Sizes are positive.

    Each document in turn is paired with all that are still open, as one: words move between the two, the same share of a copy to or from
    each open document, until the document is whole or one of the open ones is, and so on until the document is whole.
    """
    n, out = len(p), np.array(p, float)
    given, s, by = out.tolist(), np.asarray(size, float).tolist(), np.argsort(out, kind="stable").tolist()
    open_ = [EDGE < x < 1 - EDGE for x in given]
    for j in range(n):
        if not open_[j]:
            out[j] = float(given[j] >= 0.5)
    shift, rest, low, high = 0.0, sum(x for x, o in zip(s, open_, strict=True) if o), 0, n - 1
    for j in range(n):
        if not open_[j]:
            continue
        open_[j] = False
        rest -= s[j]
        x = given[j] + shift
        while EDGE < x < 1 - EDGE:
            while low <= high and not open_[by[low]]:
                low += 1
            while low <= high and not open_[by[high]]:
                high -= 1
            if low > high:
                out[j] = x
                return out
            up = min((1 - x) * s[j], (given[by[low]] + shift) * rest)  # words that the document can take, or give
            down = min(x * s[j], (1 - given[by[high]] - shift) * rest)
            moved = up if r.random() * (up + down) < down else -down
            x += moved / s[j]
            shift -= moved / rest
            for end, whole in ((low, 0.0), (high, 1.0)):
                step = 1 if end == low else -1
                while 0 <= end < n and (not open_[by[end]] or abs(given[by[end]] + shift - whole) < EDGE):
                    if open_[k := by[end]]:
                        open_[k], out[k] = False, whole
                        rest -= s[k]
                    end += step
        out[j] = float(x >= 0.5)
    return out


def _round(level: int):
    def f(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "none", "key", "tie"], ascending=[False, True, True, True], kind="stable")
        name = f"{level}|{rows['source'].iloc[0]}|{rows['slice'].iloc[0]}"
        return rows.assign(p=pivot(rows["p"].to_numpy(), rows["size"].to_numpy(), np.random.default_rng(zlib.crc32(name.encode()))))

    return f


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source: ``source, source_size, n, target``. The level of the targets is found by aggregates over this table."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    table = F.array(*[F.lit(float(w)) for w in weights])
    ranked = global_rank(sums, [F.col("source").asc_nulls_last()], "rank")
    sources = materialize(ranked.withColumn("weight", F.get(table, (F.col("rank") % len(weights)).cast("int"))).drop("rank"), "sources")
    cap = F.lit(most) * F.col("source_size")
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        at = (cap <= F.lit(level) * F.col("weight")) | (cap == 0)
        one = sources.agg(F.sum(F.when(at, cap).otherwise(0.0)).alias("cap"), F.sum(F.when(at, 0.0).otherwise(F.col("weight"))).alias("w"), F.sum(at.cast("int")).alias("n")).first()
        if one["n"] in (None, full):
            break
        full = one["n"]
        if not one["w"]:
            break
        level = max(0.0, total - one["cap"]) / one["w"]
    return sources.withColumn("target", F.least(cap, F.lit(level) * F.col("weight"))).drop("weight")


def rounded(todo: DataFrame) -> DataFrame:
    """``p`` of a table of ``source, slice, key, tie, size, p`` made 0 or 1."""
    # a column with nulls would come to pandas as floating point, which large keys overflow
    todo = todo.withColumn("none", F.col("key").isNull()).withColumn("key", F.coalesce("key", F.lit(0).cast(todo.schema["key"].dataType)))
    done, level = None, 0
    while True:
        out = materialize(todo.groupBy("source", "slice").applyInPandas(_round(level), todo.schema), "rounded")
        whole, left = out.filter("p = 0 or p = 1"), out.filter("p > 0 and p < 1")
        done = whole if done is None else done.unionByName(whole)
        if not left.agg(F.max("slice")).first()[0]:  # one document of a source at most
            break
        todo = left.withColumn("slice", F.floor(F.col("slice") / FAN).cast("long"))
        level += 1
    alone = F.pmod(F.xxhash64("key", "tie", F.lit("last")), F.lit(1 << 30)) / float(1 << 30)
    return done.unionByName(left.withColumn("p", (alone < F.col("p")).cast("double")))


def copies(sized: DataFrame, **how) -> DataFrame:
    """Adds ``source_size, target, copies`` to a written table of ``row, key, source, size, tie``."""
    goals = materialize(source_targets(sized, **how), "targets").select(F.col("source").alias("_s"), "source_size", "target", "n")
    same = ["key", "source", "size", "tie"]
    equal = sized.groupBy(*same).agg(F.count("*").alias("rows"), F.min("row").alias("row"))
    df = equal.join(goals, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    times = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    extra = F.col("rows") * (times - F.floor(times))
    df = df.withColumn("whole", F.floor(times).cast("int")).withColumn("more", F.floor(extra).cast("long")).withColumn("p", extra - F.floor(extra))
    df = materialize(df.withColumn("slice", F.pmod(F.xxhash64("key", "tie"), F.ceil(F.col("n") / SLICE))).drop("n"), "groups")
    # the group's name is its least row
    up = rounded(df.filter("p > 0").select("source", "slice", "key", "tie", "size", "p", "row")).filter("p = 1").select(F.col("row").alias("_r"), F.lit(1).alias("_up"))
    placed = df.join(up, F.col("row") == F.col("_r"), "left").withColumn("more", F.col("more") + F.coalesce("_up", F.lit(0)))
    keep = ["row", "key", "source", "size", "tie", "source_size", "target"]
    ones = placed.filter("rows = 1").select(*keep, (F.col("whole") + F.col("more")).cast("int").alias("copies"))
    groups = placed.filter("rows > 1")
    if groups.isEmpty():
        return ones
    # of equal rows the first ones get one more
    groups = groups.select(F.col("row").alias("_g"), *[F.col(c).alias(f"_{c}") for c in same], "source_size", "target", "whole", "more")
    met = sized.join(groups, F.col("tie").eqNullSafe(F.col("_tie")) & F.col("key").eqNullSafe(F.col("_key")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")))
    members = materialize(met.drop(*[f"_{c}" for c in same]).withColumn("_one", F.lit(1)), "repeated")
    ranked = running_total(members, ["_g"], ["row"], "_one", "_rank")
    return ones.unionByName(ranked.select(*keep, (F.col("whole") + (F.col("_rank") < F.col("more")).cast("int")).alias("copies")))


def sizes(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", row: str | None = None) -> DataFrame:
    own = F.col(row) if row else F.monotonically_increasing_id()
    body = F.coalesce(F.col(text), F.lit(""))
    return materialize(docs.select(own.alias("row"), F.col(key).alias("key"), F.col(source).alias("source"), F.regexp_count(body, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("tie")), "sizes")


def mix_plan(docs: DataFrame, **how) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken`` (and ``copies``)."""
    with scratch(docs.sparkSession) as keep:
        plan = keep(copies(sizes(docs), **how), "plan")
    return plan.select(F.col("key").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed table itself: documents repeated as often as they are taken, with their own columns."""
    kept = materialize(docs.select(F.struct(*docs.columns).alias("_doc"), F.monotonically_increasing_id().alias("_row")), "mixed")
    with scratch(docs.sparkSession) as keep:
        plan = keep(copies(sizes(kept.select("_doc.*", "_row"), row="_row"), **how).filter("copies > 0").select("row", "copies"), "plan")
    return kept.join(plan, F.col("_row") == F.col("row")).select("_doc", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("_doc.*")
