"""HTML and canonical source of whole tables: texts without notation are projected by Column expressions, only the rest goes through the parser.

What counts as notation is any trigger character and, for HTML, any private-use mark (it keeps line ends apart although it is dropped).
Null texts have null projections, empty ones empty ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.tables import SENTINELS
from .parse import PARTS, parse, spread

_MARKS = f"[{''.join(SENTINELS.values())}]"


def plain_html(source: Column) -> Column:
    """Paragraphs of a text without notation: blank lines part them, single line ends break them."""
    body = F.btrim(X.sanitize(source), F.lit("\n"))
    broken = lambda x: F.replace(X.escape_html(x), F.lit("\n"), F.lit("<br />\n"))
    # escaped text holds no tag, so breaks in a row are blank lines
    inside = lambda x: F.when(x.contains("\n\n"), F.regexp_replace(broken(x), "(?:<br />\n){2,}", "</p>\n<p>")).otherwise(broken(x))
    return X.let(body, lambda x: F.when(x == "", "").otherwise(F.concat(F.lit("<p>"), inside(x), F.lit("</p>\n"))))


def plain_source(source: Column) -> Column:
    """The canonical form of a text without notation; private-use marks go first."""
    return X.isolate_rules(X.cap_newlines(X.sanitize(X.let(source, lambda c: F.when(X.has_any(c, SENTINELS.values()), F.regexp_replace(c, _MARKS, "")).otherwise(c)))))


#: Projections that texts without notation have in Column expressions, and what they must not hold.
NATIVE = {"html": (plain_html, lambda c: X.has_trigger(c) | X.has_any(c, SENTINELS.values())), "serialized": (plain_source, X.has_trigger)}


def render(df: DataFrame, parts: Sequence[str] = ("html",), source: str = "source") -> DataFrame:
    """Adds a column for each of ``parts`` (``html``, ``serialized``).

    A table in which no text has notation gets a plan without Python; that takes one scan of the texts until one is found.
    """
    noted = reduce(lambda a, b: a | b, [F.coalesce(NATIVE[p][1](F.col(source)), F.lit(False)) for p in parts])
    native = spread(df).filter(~noted).select(*df.columns, *[NATIVE[p][0](F.col(source)).alias(p) for p in parts])
    rest = df.filter(noted)
    if rest.isEmpty():
        return native
    return native.unionByName(parse(rest, parts, source, "_parsed").select(*df.columns, *[F.col(f"_parsed.{p}").cast(PARTS[p][0]).alias(p) for p in parts]))
