"""Lookups and joins: vocabulary tables, nodes at positions, prioritised character resolution, key comparisons.

Vocabulary tables have a fixed number of rows (4,354 at most) and are broadcast for that reason; no other side is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions.tables import BLOCK_KINDS, GAIJI_DESCRIPTIONS, HOLDER_KINDS, table
from .parse import spread


def canonical_slug(df: DataFrame, slug: str, out: str = "canonical") -> DataFrame:
    """Canonical slugs stay, variants become canonical, others null."""
    slugs = table(df.sparkSession, "slugs").select(F.col("canonical").alias("_exact"))
    variants = table(df.sparkSession, "variants").select(F.col("variant").alias("_variant"), F.col("canonical").alias("_of"))
    both = df.join(F.broadcast(slugs), F.col(slug) == F.col("_exact"), "left").join(F.broadcast(variants), F.col(slug) == F.col("_variant"), "left")
    return both.withColumn(out, F.coalesce("_exact", "_of")).drop("_exact", "_variant", "_of")


def slug_partners(slugs: DataFrame) -> DataFrame:
    """Openers with their closers."""
    a, b = slugs.alias("a"), slugs.alias("b")
    return a.join(b, F.col("a.partner") == F.col("b.canonical")).select(F.col("a.canonical").alias("slug"), F.col("b.canonical").alias("partner"), F.col("b.partner").alias("back"))


def resolve_gaiji(df: DataFrame, existing: Column, mencode: Column, description: Column, out: str = "ucs", descriptions: DataFrame | None = None) -> DataFrame:
    """The character: existing, by code table, by ``U+hex``, by description, a single-character description itself, null.

    ``descriptions`` (``description, ucs``) may add entries; the built-in ones win. It is joined as it is, with no size assumed.
    """
    spark = df.sparkSession
    codes = F.broadcast(table(spark, "gaiji").select(F.col("mencode").alias("_code"), F.col("ucs").alias("_by_code")))
    hexed = F.regexp_extract(mencode, r"^U\+([0-9A-Fa-f]{1,6})\z", 1)
    code = F.conv(F.nullif(hexed, F.lit("")), 16, 10).cast("long")
    by_hex = F.when((code < 0x110000) & ~code.between(0xD800, 0xDFFF), X.from_code(code))
    known = F.create_map(*[F.lit(x) for p in GAIJI_DESCRIPTIONS.items() for x in p])
    df = df.withColumn("_m", mencode).withColumn("_d", description)
    joined = df.join(codes, F.col("_m") == F.col("_code"), "left")
    by_text = F.element_at(known, F.col("_d"))
    more = []
    if descriptions is not None:
        joined = joined.join(descriptions.select(F.col("description").alias("_text"), F.col("ucs").alias("_by_text")), F.col("_d") == F.col("_text"), "left")
        by_text = F.coalesce(by_text, F.col("_by_text"))
        more = ["_text", "_by_text"]
    single = F.when(F.length("_d") == 1, F.col("_d"))
    return joined.withColumn(out, F.coalesce(existing, F.col("_by_code"), by_hex, by_text, single)).drop("_m", "_d", "_code", "_by_code", *more)


def merge_preferring(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """All of ``first`` and what ``second`` has under other keys."""
    return first.unionByName(second.join(first.select(key), key, "left_anti"))


#: Positions of a document that are looked up in one group; it holds as many distinct points and starts at most.
STRETCH = 1 << 16


def _so_far(events: DataFrame, keys: list[str], value: str, how, order: list[str], out: str) -> DataFrame:
    """Adds ``out``: ``how`` (a running sum or maximum) of ``value`` over the events so far among those with equal ``keys``.

    Keys are cut into stretches of positions (``_p``): what came before a stretch is an aggregate of one row for each, so that no key is one group.
    """
    events = events.withColumn("_s", F.floor(F.col("_p") / STRETCH))
    parts = events.groupBy(*keys, "_s").agg(how(value).alias("_part"))
    before = parts.select(*[F.col(k).alias(f"{k}_") for k in keys], F.col("_s").alias("_s_"), how("_part").over(Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)).alias("_base"))
    own = how(value).over(Window.partitionBy(*keys, "_s").orderBy("_p", *order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = events.withColumn("_own", own).join(before, reduce(lambda a, b: a & b, [F.col(k) == F.col(f"{k}_") for k in keys], F.col("_s") == F.col("_s_")))
    both = F.coalesce(F.col("_own") + F.col("_base"), "_own", "_base") if how is F.sum else F.greatest("_own", "_base")
    return met.withColumn(out, both).drop("_own", "_base", "_s", "_s_", *[f"{k}_" for k in keys])


def node_at(points: DataFrame, nodes: DataFrame, key: str = "doc_id", offset: str = "offset", nested: bool = False) -> DataFrame:
    """The node whose source span holds each point, or nulls: ``node_kind, node_start, node_end``.

    The last start at or before the point decides (of equal starts the shortest span, of equal spans the last kind): if that node has ended, none holds the point. With ``nested``
    the innermost of properly nested spans does, which is the last one opened at the depth that the point has. Distinct points
    and starts are one ordered union, so that a document with n nodes and m points takes n + m rows; points with a null key or offset get nulls.
    """
    asked = points.select(F.col(key).alias("_k"), F.col(offset).cast("long").alias("_p")).filter("_k is not null and _p is not null").distinct()
    spans = nodes.filter(F.col(key).isNotNull() & (F.col("start") < F.col("end"))).select(F.col(key).alias("_k"), F.struct(F.col("start").cast("long").alias("s"), (-F.col("end").cast("long")).alias("e"), F.col("kind").alias("k")).alias("_span"))
    opens = spans.select("_k", F.col("_span.s").alias("_p"), F.lit(1).alias("_turn"), "_span")
    wanted = asked.select("_k", "_p", F.lit(0).alias("_turn"), F.lit(None).cast(spans.schema["_span"].dataType).alias("_span"))
    if nested:
        closes = spans.select("_k", (-F.col("_span.e")).alias("_p"), F.lit(-1).alias("_turn"), F.lit(None).cast(spans.schema["_span"].dataType).alias("_span"))
        # at one position spans end, then begin, the longest first, then points are asked for
        events = opens.unionByName(closes).unionByName(wanted).withColumn("_rank", F.when(F.col("_turn") == 0, 2).otherwise(F.col("_turn")))
        deep = _so_far(events, ["_k"], "_turn", F.sum, ["_rank", "_span"], "_depth").filter("_turn >= 0")
        found = _so_far(deep, ["_k", "_depth"], "_span", F.max, ["_rank", "_span"], "_last").filter("_turn = 0")
    else:
        events = opens.unionByName(wanted).withColumn("_rank", F.when(F.col("_turn") == 0, 2).otherwise(1))
        found = _so_far(events, ["_k"], "_span", F.max, ["_rank"], "_last").filter("_turn = 0")
    kind = nodes.schema["kind"].dataType
    holds = F.col("_p") < -F.col("_last.e")
    answers = found.filter(holds).select("_k", "_p", F.col("_last.k").cast(kind).alias("node_kind"), F.col("_last.s").cast(nodes.schema["start"].dataType).alias("node_start"), (-F.col("_last.e")).cast(nodes.schema["end"].dataType).alias("node_end"))
    return points.join(answers, (F.col(key) == F.col("_k")) & (F.col(offset).cast("long") == F.col("_p")), "left").drop("_k", "_p")


def node_at_normalized(points: DataFrame, nodes: DataFrame, key: str = "doc_id", offset: str = "offset") -> DataFrame:
    own = nodes.select(F.col(key).alias("_k"), F.col("norm_pos").alias("_p"), F.col("node_ref"), F.col("kind").alias("node_kind"))
    return points.join(own, (F.col(key) == F.col("_k")) & (F.col(offset) == F.col("_p")), "left").drop("_k", "_p")


def count_by_ref(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("node_ref").agg(F.count("*").alias("n"))


def is_block(kind: Column) -> Column:
    """Whether nodes of the kind stand where a paragraph does; null for null."""
    return kind.isin(BLOCK_KINDS)


def contains_inlines(kind: Column) -> Column:
    """Whether nodes of the kind hold running text of their own; a container holds blocks. Null for null."""
    return kind.isin(HOLDER_KINDS)


#: Different quoted texts of a document from which the stricter rule for targets, where it is asked for, looks at quotes only.
QUOTED_FROM = 64


def quoted_texts(text: Column) -> Column:
    """``body, at`` for each opening quote: the text up to the next closing quote, if there is any, and the byte where the quote is opened."""
    none = F.array().cast("array<struct<body:string,at:bigint>>")
    after = lambda p, k: F.array_join(F.slice(p, k, F.size(p)), "「")
    before = lambda p, k: F.octet_length(F.array_join(F.slice(p, F.lit(1), k - 1), "「"))

    def opened(stretch: Column, at: Column) -> Column:
        each = lambda p: F.transform(F.sequence(F.lit(2), F.size(p)), lambda k: F.struct(after(p, k).alias("body"), (at + before(p, k)).alias("at")))
        return F.when(stretch.contains("「"), X.let(F.split(stretch, "「"), each)).otherwise(none)

    def all_of(stretches: Column) -> Column:
        sizes = F.transform(stretches, lambda x: (F.octet_length(x) + 3).cast("long"))
        starts = X.let(sizes, lambda n: X.running_sums(n))
        return X.let(starts, lambda s: F.flatten(F.transform(stretches, lambda x, i: opened(x, F.get(s, i)))))

    closed = X.let(F.split(text, "」"), lambda p: F.slice(p, F.lit(1), F.size(p) - 1))
    return F.filter(X.let(closed, all_of), lambda q: q["body"] != "")


def targets_precede(df: DataFrame, text: str, cutoff: str, targets: str, out: str = "precede", quoted_from: int | None = None) -> DataFrame:
    """Whether every target occurs before the byte ``cutoff`` of the text.

    With ``quoted_from``, in texts with at least so many different quoted texts a target must be one of these, opened before the cutoff.
    """
    before = X.byte_slice(F.col(text), F.lit(0), F.col(cutoff))
    anywhere = F.forall(targets, lambda t: F.position(t, before) > 0)
    if quoted_from is None:
        return df.withColumn(out, anywhere)
    quoted = lambda q: F.forall(targets, lambda t: F.exists(q, lambda x: (x["body"] == t) & (x["at"] < F.col(cutoff))))
    many = lambda q: F.size(F.array_distinct(F.transform(q, lambda x: x["body"]))) >= quoted_from
    return spread(df).withColumn(out, X.let(quoted_texts(F.col(text)), lambda q: F.when(many(q), quoted(q)).otherwise(anywhere)))


def compare_shares(before: DataFrame, after: DataFrame, key: str, share: str) -> DataFrame:
    """Full outer comparison: ``before_pct, after_pct, delta_pct, status``; a missing side is 0, rows with nothing on both are left out."""
    b = before.select(F.col(key).alias("_b"), F.col(share).alias("_bp"))
    a = after.select(F.col(key).alias("_a"), F.col(share).alias("_ap"))
    both = b.join(a, F.col("_b").eqNullSafe(F.col("_a")), "full_outer")
    x, y = F.coalesce("_bp", F.lit(0.0)), F.coalesce("_ap", F.lit(0.0))
    status = F.when((x > 0) & (y > 0), "shifted").when(y > 0, "appeared").when(x > 0, "disappeared")
    return both.select(F.coalesce("_b", "_a").alias(key), x.alias("before_pct"), y.alias("after_pct"), (y - x).alias("delta_pct"), status.alias("status")).filter("status is not null")
