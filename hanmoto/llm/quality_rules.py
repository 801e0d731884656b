"""Quality rules with host-level verdicts (native DataFrame code only).

Base rules look at one document. Their failures are then counted by host, each host's failure rate is shrunk towards the corpus
by a beta prior fitted to all hosts by the method of moments, and documents of hosts with a high shrunk rate are rejected too.

Defined results: a null text has no words and fails; a null host is a host like any other; repeated rows and ids each count as a
document; an empty table gives an empty table; extra columns are ignored by ``quality`` and kept by ``keep_good``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, words

MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
#: A host is rejected when its shrunk failure rate exceeds this.
MAX_HOST_RATE = 0.6
#: Bounds of the prior's weight, in documents.
PRIOR_WEIGHT = (10.0, 1e6)
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def let(value: Column, f) -> Column:
    """``f(value)`` with the value computed once, wherever the optimizer moves the expression."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _repeats(hashes: Column) -> Column:
    """How many words lie in a window that is found twice or more, from the words' hashes."""
    window = lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)])
    windows = F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), window)

    def starts(ranked: Column) -> Column:
        at = lambda k: F.get(ranked, k)["h"]
        twice = F.filter(ranked, lambda p, k: F.coalesce(p["h"] == at(k - 1), F.lit(False)) | F.coalesce(p["h"] == at(k + 1), F.lit(False)))
        return F.array_sort(F.transform(twice, lambda p: p["i"]))

    def covered(first: Column) -> Column:
        gaps = F.transform(first, lambda s, k: F.least(F.lit(WINDOW), F.coalesce(s - F.get(first, k - 1), F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    def count(w: Column) -> Column:
        ranked = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) < F.size(w), let(ranked, lambda r: let(starts(r), covered))).otherwise(F.lit(0).cast("long"))

    return F.when(F.size(hashes) >= WINDOW, let(windows, count)).otherwise(F.lit(0).cast("long"))


def counts(text: Column) -> Column:
    """The base counts of a text and ``base_failed``, as one struct."""
    body = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    duplicates = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))

    def of(w: Column) -> Column:
        n = F.size(w).cast("long")
        chars = F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
        repeated = let(F.transform(w, lambda x: F.xxhash64(x)), _repeats)
        failed = lambda r: (n < MIN_WORDS) | (100 * r > MAX_REPEAT_PERCENT * n)
        symbols = F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long")
        return let(repeated, lambda r: F.struct(*[c.alias(x) for c, x in zip((n, chars, symbols, duplicates, r), FEATURES, strict=True)], failed(r).alias("base_failed")))

    return let(words(text), of)


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the base counts and ``base_failed``. All work is per row, inside one stage."""
    return docs.withColumn("_counts", counts(F.col(text))).select(*docs.columns, "_counts.*")


def host_verdicts(counted: DataFrame, host: str, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per host (``host, n, failed, rate, rejected``) from rows with ``base_failed``; written to the shared folder."""
    hosts = materialize(counted.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed")), "hosts")
    share = F.col("failed") / F.col("n")
    one = hosts.agg(F.sum("n").alias("n"), F.sum("failed").alias("f"), F.sum(F.col("n") * share * share).alias("sq"), F.count("*").alias("hosts")).first()
    n = one["n"] or 1
    mean = (one["f"] or 0) / n
    # the spread of the hosts' true rates: what chance alone adds to rates of few documents is taken off
    variance = (one["sq"] or 0) / n - mean * mean - mean * (1 - mean) * one["hosts"] / n
    weight = PRIOR_WEIGHT[1] if variance <= 0 else min(max(mean * (1 - mean) / variance - 1, PRIOR_WEIGHT[0]), PRIOR_WEIGHT[1])
    rate = (F.col("failed") + F.lit(mean * weight)) / (F.col("n") + F.lit(weight))
    return hosts.withColumn("rate", rate).withColumn("rejected", rate > max_rate)


def _join_verdicts(df: DataFrame, verdicts: DataFrame, host: str) -> DataFrame:
    """Only rejected hosts are joined; Spark broadcasts them if their measured size allows it and else splits a hot host's rows."""
    bad = verdicts.filter("rejected").select(F.col("host").alias("_host"), F.lit(True).alias("_bad"))
    return df.join(bad, F.col(host).eqNullSafe(F.col("_host")), "left").withColumn("kept", ~F.col("base_failed") & F.col("_bad").isNull()).drop("_host", "_bad")


def quality(docs: DataFrame, text: str = "text", host: str = "source", key: str = "doc_id") -> DataFrame:
    """One row per document: key, the base counts, ``base_failed`` and ``kept``."""
    counted = materialize(features(docs.select(key, host, text), text).drop(text), "quality")
    return _join_verdicts(counted, host_verdicts(counted, host), host).select(key, *FEATURES, "base_failed", "kept")


def keep_good(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The documents that pass, with their own columns. Texts are counted once; what passes the base rules is written until the hosts are
    judged, and of what fails only the host. Texts are never shuffled if the rejected hosts are few."""
    own = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(text).alias("_text"), F.col(host).alias("_of"))
    judged = own.select("_doc", "_of", counts(F.col("_text"))["base_failed"].alias("base_failed"))
    judged = materialize(judged.select(F.when(~F.col("base_failed"), F.col("_doc")).alias("_doc"), "_of", "base_failed"), "judged")
    verdicts = host_verdicts(judged.select("_of", "base_failed"), "_of")
    return _join_verdicts(judged.filter("not base_failed"), verdicts, "_of").filter("kept").select("_doc.*")
