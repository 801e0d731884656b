"""Text functions as Column expressions, without Python."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tables import ACCENTS, CLOSERS, OPENERS, SENTINELS, TRIGGERS

#: Unicode white space for Java's expressions.
JAVA_WHITE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_TOKENS = r"《《|》》|[｜《》［］＃※〔〕「」]|\n|[^｜《》［］＃※〔〕「」\n]+"


def has_any(c: Column, parts: Iterable[str]) -> Column:
    """Whether any of the parts occurs. Searches for bytes take a small share of the time of a regular expression over characters."""
    return let(c, lambda c: reduce(lambda a, b: a | b, [c.contains(p) for p in parts]))


def trim(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, f"^{JAVA_WHITE}+|{JAVA_WHITE}+\\z", "")


def strip_bom(c: Column) -> Column:
    return let(c, lambda c: F.when(c.startswith("\ufeff"), F.regexp_replace(c, "^\\x{FEFF}+", "")).otherwise(c))


def normalize_line_ends(c: Column) -> Column:
    return let(c, lambda c: F.when(c.contains("\r"), F.regexp_replace(c, "\r\n?", "\n")).otherwise(c))


def is_rule(line: Column) -> Column:
    """A line of ten or more of one of ``-``, ``=``, ``_``, white space around it aside."""
    return trim(line).rlike(r"^([-=_])\1{9,}\z")


def isolate_rules(c: Column) -> Column:
    """A blank line before each rule line that follows a line with something on it; linear, per row."""
    after = lambda lines: F.transform(lines, lambda x, i: F.when((i > 0) & is_rule(x) & (trim(F.get(lines, i - 1)) != ""), F.concat(F.lit("\n"), x)).otherwise(x))
    return let(c, lambda c: F.when(has_any(c, ["-" * 10, "=" * 10, "_" * 10]), F.array_join(let(F.split(c, "\n"), after), "\n")).otherwise(c))


def rewrite_accents(c: Column) -> Column:
    """Digraphs inside tortoise-shell brackets become accented letters, longest match first; a bracket ends at the first closer, one without a closer is text."""
    pieces = F.regexp_extract_all(c, F.lit("〔[^〕]*〕|[^〔]+|〔"), F.lit(0))
    inside = lambda x: x.startswith("〔") & x.endswith("〕")
    return F.when(c.contains("〔"), F.array_join(F.transform(pieces, lambda x: F.when(inside(x), decompose(x)).otherwise(x)), "")).otherwise(c)


def decompose(fragment: Column) -> Column:
    """Digraphs of a fragment as letters, without Python: pieces come from one alternation, so matching is left to right."""
    pieces = "|".join([*(re.escape(x) for x in sorted(ACCENTS, key=len, reverse=True)), "(?s:.)"])
    table = F.create_map(*[F.lit(x) for pair in ACCENTS.items() for x in pair])
    return F.array_join(F.transform(F.regexp_extract_all(fragment, F.lit(pieces), F.lit(0)), lambda x: F.coalesce(F.element_at(table, x), x)), "")


def has_accent_mark(c: Column) -> Column:
    return c.rlike("['`^:~&,/_]")


def sanitize(c: Column) -> Column:
    """The whole first phase, in its order: byte-order marks, line ends, rule lines, accents."""
    return let(isolate_rules(normalize_line_ends(strip_bom(c))), rewrite_accents)


def tokens(c: Column) -> Column:
    """The token texts in order; doubled angle brackets are one token."""
    return F.regexp_extract_all(c, F.lit(_TOKENS), F.lit(0))


def let(value: Column, f) -> Column:
    """``f(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def running_sums(lengths: Column, chunk: int = 64) -> Column:
    """For each element the sum of those before it, in the row itself: inside each chunk first, then the sums of the chunks are added."""
    grown = lambda xs: F.aggregate(xs, F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

    def sums(n: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.floor((F.size(n) - 1) / chunk).cast("int"))
        inside = F.transform(chunks, lambda c: grown(F.slice(n, c * chunk + 1, F.lit(chunk))))
        last = lambda parts: grown(F.transform(parts, lambda p: F.element_at(p, -1)))
        moved = lambda parts, b: F.transform(parts, lambda p, c: F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda x: x + F.get(b, c)))
        return F.flatten(let(inside, lambda parts: let(last(parts), lambda b: moved(parts, b))))

    return let(lengths, lambda n: F.when(F.size(n) > 0, sums(n)).otherwise(F.array().cast("array<long>")))


def trigger_kind(token: Column) -> Column:
    """The kind of a trigger token, null for others."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in TRIGGERS.items() for x in pair]), token)


def token_kind(token: Column) -> Column:
    return F.when(trigger_kind(token).isNotNull(), "trigger").when(token == "\n", "newline").otherwise("text")


def pair_kind(token: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in (OPENERS | CLOSERS).items() for x in pair]), token)


def has_trigger(c: Column) -> Column:
    return has_any(c, "｜《》［］＃※〔〕「」")


def sentinel(kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in SENTINELS.items() for x in pair]), kind)


def sentinel_kind(char: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, v in SENTINELS.items() for x in (v, k)]), char)


def byte_slice(c: Column, start: Column, end: Column) -> Column:
    """The text between two byte positions."""
    return F.decode(F.substring(F.encode(c, "UTF-8"), start + 1, end - start), "UTF-8")


def escape_html(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def cap_newlines(c: Column) -> Column:
    return let(c, lambda c: F.when(c.contains("\n\n\n"), F.regexp_replace(c, "\n{3,}", "\n\n")).otherwise(c))


def mencode(plane: Column, row: Column, cell: Column) -> Column:
    return F.format_string("第%d水準%d-%d-%d", plane + 2, plane, row, cell)


def code_points(c: Column) -> Column:
    """``U+XXXX``, four digits at least, blanks between."""
    points = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.concat(F.lit("U+"), _hex4(_code(x))))
    return F.array_join(points, " ")


def _hex4(n: Column) -> Column:
    return F.when(F.length(F.hex(n)) < 4, F.lpad(F.hex(n), 4, "0")).otherwise(F.hex(n))


def _code(x: Column) -> Column:
    """The number of a one-character text, from its UTF-32 bytes."""
    return F.conv(F.hex(F.encode(x, "UTF-32")), 16, 10).cast("long")


def from_code(n: Column) -> Column:
    """The character of a code point (Spark's own ``chr`` stops at 255)."""
    return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")


def parse_u8(c: Column) -> Column:
    """The number that ASCII or full-width digits at the beginning make, null if there are none or it is over 255."""
    digits = F.regexp_extract(F.translate(c, "０１２３４５６７８９", "0123456789"), "^0*([0-9]+)", 1)
    n = F.when(F.length(digits).between(1, 3), digits.cast("int"))
    return F.when(n < 256, n.cast("smallint"))


def size_band(n_bytes: Column) -> Column:
    return F.when(n_bytes < 50 * 1024, "small").when(n_bytes < 500 * 1024, "medium").when(n_bytes < 2 * 1024 * 1024, "large").otherwise("pathological")


def truncate(c: Column, most: int) -> Column:
    """At most so many characters; the last one of a cut text is an ellipsis."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("…"))).otherwise(c)


def bar(count: Column, largest: Column, width: int) -> Column:
    """A row of full blocks in proportion, rounded half up."""
    n = F.when(largest == 0, 0).otherwise(F.round(count / largest * width)).cast("int")
    return F.repeat(F.lit("█"), n)


def parse_rfc3339_z(c: Column) -> Column:
    """Seconds of a 20-character time that ends in Z, else null."""
    return F.when((F.length(c) == 20) & c.endswith("Z"), F.unix_timestamp(F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))))


def epoch_day(year: Column, month: Column, day: Column) -> Column:
    return F.unix_date(F.make_date(year, month, day))


def mtime_ns(t: Column) -> Column:
    return F.unix_micros(t) * 1000


def frame_label(name: Column, address: Column) -> Column:
    """A frame without a name shows its address."""
    return F.when(F.coalesce(name, F.lit("")) == "", F.concat(F.lit("0x"), F.lower(F.hex(address)))).otherwise(name)


def row_kind(label: Column, self_pct: Column, incl_pct: Column) -> Column:
    share = self_pct / incl_pct
    return F.when(label.startswith("0x"), "??").when((incl_pct >= 95.0) & (self_pct < 1.0), "EP").when((incl_pct == 0.0) | (share >= 0.9), "LH").when(share >= 0.5, "HW").otherwise("WR")
