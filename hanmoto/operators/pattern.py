"""Patterns over the tree: ``(Kind @name)`` or ``(_)``, any number of them, white space between.

Patterns are read on the driver and become one predicate for each, so matching is a projection of the tree's rows.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import WHITE

KINDS = ["Document", "Container", "Construct", "Plain", "ConstructText", "ContainerOpen", "ContainerClose"]
_NAME = re.compile("[A-Za-z0-9_-]+")


class Pattern(NamedTuple):
    kind: str | None  # None: any
    name: str


class PatternError(ValueError):
    """``what``: unexpected, unexpected_end or unknown_kind; ``offset`` in bytes."""

    def __init__(self, what: str, offset: int, found: str = ""):
        super().__init__(f"{what} at byte {offset}: {found!r}")
        self.what, self.offset, self.found = what, offset, found


def compile_patterns(text: str) -> list[Pattern]:
    at, out = 0, []
    offset = lambda i: len(text[:i].encode())

    def fail(i: int) -> PatternError:
        return PatternError("unexpected", offset(i), text[i]) if i < len(text) else PatternError("unexpected_end", offset(i))

    def skip(i: int) -> int:
        while i < len(text) and text[i] in WHITE:
            i += 1
        return i

    def expect(i: int, char: str) -> int:
        if text[i : i + 1] != char:
            raise fail(i)
        return i + 1

    def name(i: int) -> tuple[str, int]:
        m = _NAME.match(text, i)
        if not m:
            raise fail(i)
        return m[0], m.end()

    at = skip(at)
    while at < len(text):
        at = skip(expect(at, "("))
        if text[at : at + 1] == "_":
            kind, at = None, at + 1
        else:
            first = at
            kind, at = name(at)
            if kind not in KINDS:
                raise PatternError("unknown_kind", offset(first), kind)
        at, capture = skip(at), ""
        if text[at : at + 1] == "@":
            capture, at = name(at + 1)
        at = skip(expect(skip(at), ")"))
        out.append(Pattern(kind, capture))
    return out


def captures(tree: DataFrame, patterns: str) -> DataFrame:
    """The tree's rows with ``capture`` and ``pattern_idx``, a row for each pattern that matches, in no order."""
    found = [F.when(F.lit(True) if p.kind is None else F.col("kind") == p.kind, F.struct(F.lit(p.name).alias("capture"), F.lit(i).alias("pattern_idx"))) for i, p in enumerate(compile_patterns(patterns))]
    if not found:
        return tree.withColumn("capture", F.lit("")).withColumn("pattern_idx", F.lit(0)).filter(F.lit(False))
    return tree.withColumn("_hit", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull()))).select(*tree.columns, "_hit.*")
