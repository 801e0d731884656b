"""Corpus statistics: size bands, quantiles of three kinds, histograms, counters.

Exact quantiles rank no whole group in one task: equal values are counted first, counts are summed by bin (about a 256th of the
value wide, at most a few hundred thousand a group, however many rows), bins that hold a wanted rank and too many different values are cut
into ever narrower ones, and only the last of these are sorted by value.
Values are numbers; nulls are left out, groups without other values are absent, NaN is the largest value, a null key is a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import size_band
from .settle import settled

#: Distinct values that are sorted together, parts into which a bin of more is cut.
MOST, PARTS = 1 << 16, 4096
BANDS = ["small", "medium", "large", "pathological"]


def _listed(df: DataFrame, labels: list[str], name: str) -> DataFrame:
    """The labels as rows with their order; as many as there are labels."""
    spark = df.sparkSession
    return F.broadcast(spark.createDataFrame([(x, i) for i, x in enumerate(labels)], f"{name} string, ord int"))


def _bin(value: Column) -> Column:
    """A number that never falls when the value rises: logarithmic, finer than 2^-20 near zero."""
    x = value.cast("double")
    size = F.least(F.log1p(F.abs(x) * 2.0**20) * 256, F.lit(1e6))
    return F.floor(F.when(x < 0, -size).otherwise(size))


def _holds(ranks: dict[str, Column], upto: Column, n: Column) -> Column:
    return reduce(lambda a, b: a | b, [(r <= upto) & (r > upto - n) for r in ranks.values()])


def _refined(values: DataFrame, keys: list[str], zones: DataFrame, ranks: dict[str, Column]) -> DataFrame:
    """The parts of the zones that hold a wanted rank, each zone cut into PARTS of equal width: a histogram of what lies in it."""
    zones = zones.withColumn("_zone", F.col("_lo"))
    x = F.col("_x")
    part = F.when(x == F.col("_hi"), PARTS).otherwise(F.least(F.lit(PARTS - 1), F.floor((x - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * PARTS)))
    within = _in_zones(values, keys, zones).withColumn("_part", F.when(F.col("_lo") == F.col("_hi"), 0).otherwise(part))
    cut = within.groupBy(*keys, "_bin", "_zone", "_part").agg(*_summary(), F.first("_base").alias("_base"), F.first("_n").alias("_n"))
    upto = F.col("_base") + F.sum("_in").over(Window.partitionBy(*keys, "_bin", "_zone").orderBy("_part"))
    found = cut.withColumn("_upto", upto).filter(_holds(ranks, F.col("_upto"), F.col("_in")))
    return found.select(*keys, "_bin", "_lo", "_hi", "_d", "_n", (F.col("_upto") - F.col("_in")).alias("_base"))


def _in_zones(values: DataFrame, keys: list[str], zones: DataFrame) -> DataFrame:
    own = zones.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bin").alias("_b"), *[c for c in zones.columns if c not in (*keys, "_bin", "_d")])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("_bin") == F.col("_b"))
    return values.join(own, same & (F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi"))).drop("_b", *[f"_k{i}" for i in range(len(keys))])


def _summary() -> list[Column]:
    return [F.sum("_c").alias("_in"), F.count("*").alias("_d"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")]


def _at_ranks(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """The values at 1-based ranks, which may use ``_n``, the group's count: one column each.

    A first read counts by bin; a bin that holds a wanted rank and more than MOST distinct values is cut again, as often as it takes (each time
    from a small written table of what was found); a last read sorts what is left, MOST values at most but for those that are equal as doubles.
    """
    x = F.col(value).cast("double")
    values = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c")).withColumn("_bin", _bin(x)).withColumn("_x", x)
    group = Window.partitionBy(*keys)
    bins = values.groupBy(*keys, "_bin").agg(*_summary())
    bins = bins.withColumn("_upto", F.sum("_in").over(group.orderBy("_bin"))).withColumn("_n", F.sum("_in").over(group))
    zones = bins.filter(_holds(ranks, F.col("_upto"), F.col("_in"))).select(*keys, "_bin", "_lo", "_hi", "_d", "_n", (F.col("_upto") - F.col("_in")).alias("_base"))
    zones, before = settled(zones), None
    while (most := zones.filter((F.col("_d") > MOST) & (F.col("_lo") < F.col("_hi"))).agg(F.max("_d"), F.sum("_d")).first())[0] is not None and most != before:
        zones, before = settled(_refined(values, keys, zones, ranks)), most
    sorted_ = Window.partitionBy(*keys, "_bin", "_lo").orderBy(value)
    ranked = _in_zones(values, keys, zones).withColumn("_hi", F.col("_base") + F.sum("_c").over(sorted_))
    return ranked.groupBy(*keys).agg(*[F.max(F.when((F.col("_hi") >= r) & (F.col("_hi") - F.col("_c") < r), F.col(value))).alias(k) for k, r in ranks.items()])


def upper_median(df: DataFrame, keys: list[str], value: str, out: str = "median") -> DataFrame:
    """Element n div 2 of the sorted values, from 0."""
    return _at_ranks(df, keys, value, {out: F.floor(F.col("_n") / 2) + 1})


def nearest_ranks(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Elements round((n - 1) * p), halves away from zero, a column for each name."""
    return _at_ranks(df, keys, value, {k: F.round((F.col("_n") - 1) * F.lit(p)).cast("long") + 1 for k, p in quantiles.items()})


def nearest_rank(df: DataFrame, keys: list[str], value: str, p: float, out: str) -> DataFrame:
    """Element round((n - 1) * p), halves away from zero."""
    return nearest_ranks(df, keys, value, {out: p})


def midpoint_median(df: DataFrame, keys: list[str], value: str, out: str = "median") -> DataFrame:
    """The middle value, or the whole part of the mean of the two in the middle."""
    both = _at_ranks(df, keys, value, {"_lo": F.floor((F.col("_n") + 1) / 2), "_up": F.floor(F.col("_n") / 2) + 1})
    return both.select(*keys, F.floor((F.col("_lo") + F.col("_up")) / 2).cast("long").alias(out))


def band_statistics(df: DataFrame, n_bytes: str, stored: str) -> DataFrame:
    """For each size band, empty ones too: count, sums, mean, upper median, maximum, stored share."""
    banded = df.withColumn("band", size_band(F.col(n_bytes)))
    sums = banded.groupBy("band").agg(F.count("*").alias("n"), F.sum(n_bytes).alias("decoded"), F.sum(stored).alias("on_disk"), F.max(n_bytes).alias("largest"))
    found = sums.join(upper_median(banded, ["band"], n_bytes), "band", "left")
    full = _listed(df, BANDS, "band").join(found, "band", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return full.select("band", zero("n").alias("n"), zero("decoded").alias("decoded"), zero("on_disk").alias("on_disk"), (F.col("decoded") / F.col("n")).alias("mean"), "median", "largest", (F.col("on_disk") / F.col("decoded")).alias("ratio"))


def labelled_histogram(df: DataFrame, value: Column, edges: list[tuple[str, float]], more: dict[str, Column] | None = None) -> DataFrame:
    """Half-open bands ``(label, upper edge)``, the last without limit if its edge is infinite; empty bands are shown; ``pct`` of all rows."""
    band = reduce(lambda w, e: w.when(value < e[1], e[0]), edges[1:], F.when(value < edges[0][1], edges[0][0]))
    counts = df.withColumn("band", band).groupBy("band").agg(F.count("*").alias("n"), *[c.alias(k) for k, c in (more or {}).items()])
    total = Window.partitionBy()
    full = _listed(df, [e[0] for e in edges], "band").join(counts, "band", "left")
    n = F.coalesce("n", F.lit(0))
    return full.select("band", n.alias("n"), F.when(F.sum(n).over(total) == 0, 0.0).otherwise(100.0 * n / F.sum(n).over(total)).alias("pct"), *(more or {}))


DIAGNOSTIC_BANDS = [("0", 1), ("1-5", 6), ("6-20", 21), ("21-100", 101), ("100+", float("inf"))]
RATIO_BANDS = [("0-1", 1.0), ("1-2", 2.0), ("2-4", 4.0), ("4-8", 8.0), ("8-16", 16.0), (">16", float("inf"))]
DEDUP_BANDS = [("0.00-0.20", 0.2), ("0.20-0.40", 0.4), ("0.40-0.60", 0.6), ("0.60-0.80", 0.8), ("0.80-0.95", 0.95), ("0.95-1.00", 1.0001)]


def diagnostic_distribution(df: DataFrame, n: str, ns: str) -> DataFrame:
    """Documents by their number of diagnostics, with the mean microseconds a document takes: ``band, n, pct, mean_us``; 0 in empty bands."""
    found = labelled_histogram(df, F.col(n), DIAGNOSTIC_BANDS, {"mean_us": F.avg(ns) / 1000})
    return found.withColumn("mean_us", F.coalesce("mean_us", F.lit(0.0)))


def ratio_statistics(df: DataFrame, value: str) -> DataFrame:
    """One row: ``n, p50, p90, p99, max, mean`` of a ratio, quantiles by nearest rank; nulls are left out, an empty table gives zeros."""
    sums = df.agg(F.count(value).alias("n"), F.max(value).alias("max"), F.avg(value).alias("mean"))
    at = nearest_ranks(df, [], value, {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    full = sums.join(F.broadcast(at))  # one row and one row
    return full.select("n", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("p50", "p90", "p99", "max", "mean")])


def dedup_histogram(df: DataFrame, reuses: str, calls: str) -> DataFrame:
    """Documents by the share of calls that found a string already there; documents without calls are left out."""
    return labelled_histogram(df.filter(F.col(calls) > 0), F.col(reuses) / F.col(calls), DEDUP_BANDS)


def slowest(df: DataFrame, phases: list[str], key: str, n_bytes: str, n: int = 5) -> DataFrame:
    """The first n documents by each of the phases, ties by key: ``phase, rank, key, ns, total_ns, n_bytes``.

    Every phase is a sort with a limit, which Spark cuts in each task, so no phase is ranked whole.
    """
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(p), F.lit(0)) for p in phases])
    found = [top(df.select(F.lit(p).alias("phase"), F.col(key), F.col(p).alias("ns"), total.alias("total_ns"), F.col(n_bytes).alias("n_bytes")), n, F.desc("ns"), F.asc(key)) for p in phases]
    order = Window.partitionBy("phase").orderBy(F.desc("ns"), F.asc(key))
    return reduce(DataFrame.unionByName, found).select("phase", F.row_number().over(order).alias("rank"), key, "ns", "total_ns", "n_bytes")


def corpus_counters(df: DataFrame, decoded: Column, counters: list[str]) -> DataFrame:
    """One row over all documents: ``documents`` and ``decode_errors``, the sum of each counter of decoded ones and its share of the first in percent.

    Counters are null where a document wasn't decoded; an empty table and a first counter of zero give zeros.
    """
    sums = df.agg(F.count_if(decoded).alias("documents"), F.count_if(~F.coalesce(decoded, F.lit(False))).alias("decode_errors"), *[F.coalesce(F.sum(F.when(decoded, F.col(c))), F.lit(0)).alias(c) for c in counters])
    share = lambda c: F.when(F.col(counters[0]) == 0, 0.0).otherwise(100.0 * F.col(c) / F.col(counters[0]))
    return sums.select("*", *[share(c).alias(f"{c}_pct") for c in counters[1:]])


def log_histogram(df: DataFrame, value: str, buckets: int, least: float, most: float) -> DataFrame:
    """``bucket, lo, hi, n``: logarithmic buckets; what lies outside goes to the first or last."""
    import math

    low, high = math.log(least), math.log(most)
    step = (high - low) / buckets
    edges = [int(math.exp(low + step * i)) for i in range(buckets + 1)]
    x = F.col(value)
    at = F.when(x <= edges[0], 0).when(x >= edges[-1], buckets - 1).otherwise(F.least(F.lit(buckets - 1), F.floor((F.log(x) - low) / step)))
    counts = df.filter(x.isNotNull()).groupBy(at.cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    listed = F.broadcast(df.sparkSession.createDataFrame([(i, edges[i], edges[i + 1]) for i in range(buckets)], "bucket int, lo long, hi long"))
    return listed.join(counts, "bucket", "left").select("bucket", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"))


def year_histogram(df: DataFrame, mtime_ns: str) -> DataFrame:
    """Files by the calendar year of their time; times up to zero are left out. (Years are those of the calendar, also in January and February.)"""
    seconds = F.floor(F.col(mtime_ns) / 1_000_000_000)
    return df.filter(F.col(mtime_ns) > 0).groupBy(F.year(F.timestamp_seconds(seconds)).alias("year")).agg(F.count("*").alias("n"))


def flag_groups(df: DataFrame, flags: dict[str, Column], n_bytes: str, ns: str) -> DataFrame:
    """Groups by which flags hold, as bits in order; all groups are shown: rows, bytes, ns, ns per byte in total and its upper median."""
    bits = reduce(lambda a, b: a + b, [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(flags.values())])
    own = df.select(bits.alias("mask"), F.col(n_bytes).alias("_b"), F.col(ns).alias("_ns"), (F.col(ns) / F.col(n_bytes)).alias("_per"))
    sums = own.groupBy("mask").agg(F.count("*").alias("n"), F.sum("_b").alias("bytes"), F.sum("_ns").alias("ns"))
    found = sums.join(upper_median(own, ["mask"], "_per", "median_ns_per_byte"), "mask", "left")
    names = list(flags)
    listed = F.broadcast(df.sparkSession.createDataFrame([(m, "+".join(x for i, x in enumerate(names) if m >> i & 1) or "none") for m in range(1 << len(names))], "mask int, label string"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return listed.join(found, "mask", "left").select("mask", "label", zero("n").alias("n"), zero("bytes").alias("bytes"), zero("ns").alias("ns"), (F.col("ns") / F.col("bytes")).alias("ns_per_byte"), "median_ns_per_byte")


def phase_totals(df: DataFrame, phases: list[str], n_bytes: str) -> DataFrame:
    """Per phase (a column of ns each): total, share of all, MB a second, and nearest-rank p50, p90, p99."""
    long = df.select(F.col(n_bytes).alias("_b"), F.explode(F.array(*[F.struct(F.lit(p).alias("phase"), F.col(p).alias("ns")) for p in phases])).alias("x")).select("_b", "x.*")
    sums = long.groupBy("phase").agg(F.sum("ns").alias("total_ns"), F.sum("_b").alias("_bytes"))
    sums = sums.join(nearest_ranks(long, ["phase"], "ns", {"p50": 0.5, "p90": 0.9, "p99": 0.99}), "phase", "left")
    whole = F.sum("total_ns").over(Window.partitionBy())
    return sums.select("phase", "total_ns", (100.0 * F.col("total_ns") / whole).alias("pct"), (F.col("_bytes") * 1000.0 / F.col("total_ns")).alias("mb_s"), "p50", "p90", "p99")


def gap_by_band(df: DataFrame, n_bytes: str, a: str, b: str) -> DataFrame:
    """By size band how much more ``a`` takes than ``b``, in percent: of the sums, and the upper median over rows."""
    own = df.select(size_band(F.col(n_bytes)).alias("band"), F.col(a).alias("_a"), F.col(b).alias("_b"), (100.0 * (F.col(a) - F.col(b)) / F.col(b)).alias("_gap"))
    sums = own.groupBy("band").agg(F.count("*").alias("n"), (100.0 * (F.sum("_a") - F.sum("_b")) / F.sum("_b")).alias("gap_pct"))
    return sums.join(upper_median(own, ["band"], "_gap", "median_gap_pct"), "band")


def archive_totals(df: DataFrame, decoded: str, stored: str) -> DataFrame:
    return df.agg(F.count("*").alias("entries"), F.sum(decoded).alias("decoded"), F.sum(stored).alias("stored"), (F.sum(stored) / F.sum(decoded)).alias("ratio"))


def interner_statistics(df: DataFrame, text: str, long_bytes: int = 64) -> DataFrame:
    """Strings that would be shared: calls, distinct short ones, too long ones, and the share saved."""
    short = F.octet_length(text) <= long_bytes
    return df.agg(F.count(text).alias("calls"), F.count_distinct(F.when(short, F.col(text))).alias("allocs"), F.count_if(~short).alias("long_bypass")).withColumn("dedup_ratio", F.when(F.col("calls") == 0, 0.0).otherwise(1 - (F.col("allocs") + F.col("long_bypass")) / F.col("calls")))


def byte_density(df: DataFrame, text: str, classes: dict[str, str]) -> DataFrame:
    """Bytes in each class of characters (a bracket expression's inside), summed over all texts, and per thousand bytes."""
    total = F.sum(F.octet_length(text)).alias("bytes")
    one = df.agg(total, *[F.sum(F.octet_length(text) - F.octet_length(F.regexp_replace(text, f"[{c}]", ""))).alias(k) for k, c in classes.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("class"), F.col(k).alias("n"), (1000.0 * F.col(k) / F.col("bytes")).alias("per_mille")) for k in classes])).alias("x")).select("x.*")


def outcome_counts(df: DataFrame, decode_error: Column, io_error: Column) -> DataFrame:
    return df.agg(F.count_if(decode_error).alias("decode_errors"), F.count_if(io_error).alias("io_errors"), F.count_if(~decode_error & ~io_error).alias("parsed"))


def conformance_summary(df: DataFrame, level: str, passed: str) -> DataFrame:
    own = df.groupBy(F.col(level).alias("level")).agg(F.count("*").alias("total"), F.count_if(F.col(passed)).alias("passed"))
    found = _listed(df, ["must", "should", "may"], "level").join(own, "level", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return found.select("level", zero("total").alias("total"), zero("passed").alias("passed"), (zero("total") - zero("passed")).alias("failed"))


def job_times(jobs: DataFrame, job: str, start: str, end: str) -> DataFrame:
    """Jobs by duration, longest first; those without an end have none and come last."""
    return jobs.select(F.col(job).alias("job"), (F.unix_timestamp(end) - F.unix_timestamp(start)).alias("seconds")).orderBy(F.col("seconds").desc_nulls_last(), "job")


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of an order that must name a tie-break."""
    return df.orderBy(*order).limit(n)


def top_steps(jobs: DataFrame, n: int) -> DataFrame:
    """From ``job, steps`` (array of name, seconds): the longest steps of over a second."""
    steps = jobs.select("job", F.explode("steps").alias("s")).select("job", F.col("s.name").alias("step"), F.col("s.seconds").alias("seconds"))
    return top(steps.filter("seconds > 1"), n, F.desc("seconds"), F.asc("job"), F.asc("step"))


def render_ratio(df: DataFrame, source: str, html: str, parse_ns: str, render_ns: str) -> DataFrame:
    """By size band: HTML bytes for each source byte, and rendering time for each unit of parsing time."""
    own = df.select(size_band(F.octet_length(source)).alias("band"), F.octet_length(source).alias("_s"), F.octet_length(html).alias("_h"), F.col(parse_ns).alias("_p"), F.col(render_ns).alias("_r"))
    return own.groupBy("band").agg(F.count("*").alias("n"), (F.sum("_h") / F.sum("_s")).alias("html_ratio"), (F.sum("_r") / F.sum("_p")).alias("time_ratio"))
