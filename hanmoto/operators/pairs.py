"""Pair matching as a fold over the row's own array: a stack machine of Column expressions, without Python and without a shuffle.

A closer matches if the innermost open bracket is of its kind; otherwise it is unmatched and the stack stays. A delimiter is one number
(16 times its byte offset, twice its kind, one more for openers), the stack an array of them. Spark copies a fold's state at every step, so
one fold over a long text would take quadratic time. Instead FANOUT delimiters are folded at a time with the FANOUT innermost brackets, which is
all they can close, then FANOUT such stretches with as much of the stack as these can close, and so on for LEVELS levels: each level
copies FANOUT numbers for each delimiter, whatever the text's length and depth, up to FANOUT^(LEVELS + 1) delimiters, and beyond that as many more as
there are stretches of FANOUT^LEVELS.

Null texts have null results, texts without delimiters empty ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.tables import CLOSERS, OPENERS, PAIR_KINDS, SENTINELS

FANOUT, LEVELS = 32, 3
_LONGS, _LINKS = "array<bigint>", "array<struct<o:bigint,c:bigint>>"
_DIAGNOSTIC = "array<struct<kind:string,severity:string,source:string,start:int,end:int,codepoint:string,pair_kind:string>>"
_ANY = f"[{''.join(sorted(set(''.join([*OPENERS, *CLOSERS]))))}]"
_MARKS = f"[{''.join(SENTINELS.values())}]"


def _starts(pieces: Column) -> Column:
    return X.let(F.transform(pieces, lambda x: F.octet_length(x).cast("long")), lambda n: X.running_sums(n))


def delimiters(text: Column) -> Column:
    """Openers and closers of a sanitised text, in order, as numbers."""
    codes = F.create_map(*[F.lit(v) for t, k in OPENERS.items() for v in (t, 2 * PAIR_KINDS.index(k) + 1)], *[F.lit(v) for t, k in CLOSERS.items() for v in (t, 2 * PAIR_KINDS.index(k))])
    numbered = lambda t: X.let(_starts(t), lambda s: F.transform(t, lambda x, i: F.get(s, i) * 16 + F.element_at(codes, x)))
    return F.when(text.rlike(_ANY), F.filter(X.let(X.tokens(text), numbered), lambda n: n.isNotNull())).when(text.isNotNull(), F.array().cast(_LONGS))


def _step(a: Column, x: Column) -> Column:
    """One delimiter: an opener goes on the stack, a closer gives its opener or -1."""
    stack, out = a["stack"], a["out"]
    last = F.get(stack, F.size(stack) - 1)
    state = lambda s, o: F.struct(s.alias("stack"), o.alias("out"))
    matched = state(F.slice(stack, F.lit(1), F.size(stack) - 1), F.concat(out, F.array(last)))
    stray = state(stack, F.concat(out, F.array(F.lit(-1).cast("bigint"))))
    return F.when(x.bitwiseAND(1) == 1, state(F.concat(stack, F.array(x)), out)).when(last.bitwiseAND(14) == x.bitwiseAND(14), matched).otherwise(stray)


def _fold(d: Column, at: Column, stack: Column, level: int) -> Column:
    """``stack`` and ``out`` after the delimiters of a stretch that begins at ``at``; its parts see no more of the stack than they could take off it."""
    begin = F.struct(stack.alias("stack"), F.array().cast(_LONGS).alias("out"))
    if level == 0:
        return F.aggregate(F.slice(d, at + 1, F.lit(FANOUT)), begin, _step)
    size = FANOUT**level
    parts = F.ceil((F.size(d) - at) / size).cast("int")
    if level < LEVELS:
        parts = F.least(parts, F.lit(FANOUT))

    def part(a: Column, c: Column) -> Column:
        under = F.greatest(F.size(a["stack"]) - size, F.lit(0))
        done = _fold(d, at + c * size, F.slice(a["stack"], under + 1, F.lit(size)), level - 1)
        return X.let(done, lambda r: F.struct(F.concat(F.slice(a["stack"], F.lit(1), under), r["stack"]).alias("stack"), F.concat(a["out"], r["out"]).alias("out")))

    return F.aggregate(F.sequence(F.lit(0), parts - 1), begin, part)


def match(numbers: Column) -> Column:
    """``pairs``, one for each closer in order (``c``, and its opener ``o`` or null), and ``left``, the openers without closers, innermost first."""

    def paired(d: Column, r: Column) -> Column:
        closers = F.filter(d, lambda n: n.bitwiseAND(1) == 0)
        both = F.zip_with(closers, r["out"], lambda c, o: F.struct(F.nullif(o, F.lit(-1)).alias("o"), c.alias("c")))
        return F.struct(both.alias("pairs"), F.reverse(r["stack"]).alias("left"))

    none = F.array().cast(_LONGS)
    folded = lambda d: X.let(_fold(d, F.lit(0), none, LEVELS), lambda r: paired(d, r))
    empty = F.struct(F.array().cast(_LINKS).alias("pairs"), none.alias("left"))
    return X.let(numbers, lambda d: F.when(F.size(d) > 0, folded(d)).when(d.isNotNull(), empty))


def containers(nodes: Column) -> Column:
    """Pairs of container openers and closers among a document's nodes, in the order of the closers, with the opener's kind and numbers.

    A closer takes the last open container of any kind; closers without one and containers that stay open make no pair. This is the same fold:
    a node's place in the array is its number, and all are of one kind.
    """
    numbers = F.transform(nodes, lambda n, i: F.when(n["node_ref"] == "blockOpen", i.cast("bigint") * 16 + 1).when(n["node_ref"] == "blockClose", i.cast("bigint") * 16))
    own = F.filter(numbers, lambda n: n.isNotNull())

    def row(p: Column) -> Column:
        o, c = (F.get(nodes, F.shiftright(p[x], 4).cast("int")) for x in ("o", "c"))
        return F.struct(o["attrs"]["container"].alias("kind"), o["attrs"]["amount"].alias("amount"), o["attrs"]["offset"].alias("offset"), o["norm_pos"].alias("open_norm"), c["norm_pos"].alias("close_norm"))

    return F.transform(F.filter(match(own)["pairs"], lambda p: p["o"].isNotNull()), row)


def kind(n: Column) -> Column:
    return F.get(F.array(*map(F.lit, PAIR_KINDS)), F.shiftright(n, 1).bitwiseAND(7).cast("int"))


def start(n: Column) -> Column:
    return F.shiftright(n, 4).cast("int")


def end(n: Column) -> Column:
    return start(n) + F.when(kind(n) == "doubleRuby", 6).otherwise(3)


def links(text: Column) -> Column:
    """Pairs of a sanitised text, in the order of their closers, with byte spans."""
    closed = X.let(match(delimiters(text)), lambda m: F.filter(m["pairs"], lambda p: p["o"].isNotNull()))
    return F.transform(closed, lambda p: F.struct(kind(p["c"]).alias("kind"), start(p["o"]).alias("open_start"), end(p["o"]).alias("open_end"), start(p["c"]).alias("close_start"), end(p["c"]).alias("close_end")))


def diagnostics(text: Column) -> Column:
    """Private-use marks of a sanitised text, then closers without openers, then openers without closers, innermost first."""

    def row(what: str, severity: str, s: Column, e: Column, mark: Column, pair: Column) -> Column:
        return F.struct(F.lit(what).alias("kind"), F.lit(severity).alias("severity"), F.lit("source").alias("source"), s.alias("start"), e.alias("end"), mark.cast("string").alias("codepoint"), pair.cast("string").alias("pair_kind"))

    no = F.lit(None)
    pieces = F.regexp_extract_all(text, F.lit(f"{_MARKS}|[^{_MARKS[1:-1]}]+"), F.lit(0))
    at = X.let(pieces, lambda p: X.let(_starts(p), lambda s: F.transform(p, lambda x, i: F.struct(x.alias("x"), F.get(s, i).cast("int").alias("s")))))
    marks = F.transform(F.filter(at, lambda p: p["x"].rlike(_MARKS)), lambda p: row("source_contains_pua", "warning", p["s"], p["s"] + 3, p["x"], no))
    marks = F.when(text.rlike(_MARKS), marks).otherwise(F.array()).cast(_DIAGNOSTIC)
    stray = lambda m: F.transform(F.filter(m["pairs"], lambda p: p["o"].isNull()), lambda p: row("unmatched_close", "error", start(p["c"]), end(p["c"]), no, kind(p["c"])))
    left = lambda m: F.transform(m["left"], lambda o: row("unclosed_bracket", "error", start(o), end(o), no, kind(o)))
    errors = X.let(match(delimiters(text)), lambda m: F.concat(stray(m), left(m)).cast(_DIAGNOSTIC))
    return F.when(text.isNotNull(), F.concat(marks, errors))


def exploded(df: DataFrame, part: Column, key: str, seq: str = "seq") -> DataFrame:
    return df.select(key, F.posexplode(part).alias(seq, "_x")).select(key, seq, "_x.*")
