"""Line removal by site-relative frequency.

By host, the number of pages that hold a line is divided by the number of pages; lines above the ratio are boilerplate of that host
and are dropped from its pages.

Defined results: a page is a row; a null host is a host; a null text is empty; lines without a word are never counted nor dropped;
a line counts once per page and is compared as text; a page of any number of lines takes time in proportion to them; hosts of fewer than
MIN_PAGES pages lose nothing; an empty table gives an empty table; other columns are kept as they are, and where one is called
``n_lines`` or ``n_dropped`` the count takes that name with ``_`` added until it is free.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, materialize

#: A line is boilerplate if more than this share of its host's pages hold it,
MAX_RATIO = 0.05
#: and at least so many pages, so that small hosts' coincidences stay.
MIN_PAGES = 5
#: Different boilerplate lines on one page that each line is compared with in turn; beyond, they are looked up in a set.
FEW = 64


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def boilerplate(pages: DataFrame, max_ratio: float, min_pages: int) -> DataFrame:
    """From ``_host, _text`` one row per host with boilerplate: ``host`` and ``drop``, its lines.

    Counting shuffles each line once per (host, map task). The lists of a host weigh less than (bytes of its average page / ratio),
    whatever its number of pages.
    """
    totals = pages.groupBy(F.col("_host").alias("_h")).agg(F.count("*").alias("_pages"))
    each = pages.select(F.col("_host").alias("host"), F.explode(F.array_distinct(F.filter(_lines(F.col("_text")), _has_word))).alias("line"))
    counts = each.groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    often = counts.join(totals, F.col("host").eqNullSafe(F.col("_h"))).filter(F.col("n") > max_ratio * F.col("_pages"))
    return materialize(often.groupBy("host").agg(F.collect_list("line").alias("drop")), "boilerplate")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _without(lines: pd.Series, bad: pd.Series) -> pd.Series:
    def one(own, gone):
        if own is None or gone is None:
            return None
        gone = set(gone)
        return [x for x in own if x not in gone]

    return pd.Series([one(x, g) for x, g in zip(lines, bad, strict=True)], dtype=object)


def drop_site_lines(docs: DataFrame, text: str = "text", host: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """The rows with ``text`` cleaned, plus ``n_lines`` and ``n_dropped``. Texts aren't shuffled if the lists are small enough to broadcast."""
    own = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(text).alias("_text"), F.col(host).alias("_host"))
    found = boilerplate(own.select("_host", "_text"), max_ratio, min_pages).select(F.col("host").alias("_of"), F.col("drop").alias("_drop"))
    df = own.join(found, F.col("_host").eqNullSafe(F.col("_of")), "left").withColumn("_lines", _lines(F.col("_text")))
    df = df.withColumn("_bad", F.when(F.col("_drop").isNotNull(), F.array_intersect("_lines", "_drop")))
    n = F.coalesce(F.size("_bad"), F.lit(0))
    many = n > FEW
    df = df.withColumn("_long", _without(F.when(many, F.col("_lines")), F.when(many, F.col("_bad"))))
    df = df.withColumn("_kept", F.when(n <= 0, F.col("_lines")).when(many, F.col("_long")).otherwise(F.filter("_lines", lambda x: ~F.array_contains(F.col("_bad"), x))))
    clean = F.when(n <= 0, F.col("_text")).otherwise(F.array_join("_kept", "\n"))
    counts = {"n_lines": F.size("_lines"), "n_dropped": F.size("_lines") - F.size("_kept")}
    return df.select(*[clean.alias(c) if c == text else F.col("_doc")[c].alias(c) for c in docs.columns], *[c.cast("long").alias(free_name(k, docs.columns)) for k, c in counts.items()])
