"""Cases with expected output, checked over a table: ``case, feature, level, source, html, serialized``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .parse import parse
from .stats import conformance_summary


def check(cases: DataFrame) -> DataFrame:
    """Each case with ``html_ok``, ``serialized_ok`` and ``passed``."""
    found = parse(cases, ["html", "serialized"], "source", "_got")
    html, text = F.col("_got.html").eqNullSafe(F.col("html")), F.col("_got.serialized").eqNullSafe(F.col("serialized"))
    return found.withColumn("html_ok", html).withColumn("serialized_ok", text).withColumn("passed", html & text).drop("_got")


def summary(cases: DataFrame) -> DataFrame:
    """Totals by level."""
    return conformance_summary(check(cases), "level", "passed")
