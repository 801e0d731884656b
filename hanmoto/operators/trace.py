"""Analytics of sampled call stacks in normalised tables.

``Trace`` holds the tables; indexes are per thread, so every join has the thread. Labels and libraries of frames are joined
once (``frames``), stacks are unrolled for all at once (``paths``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import frame_label, let, row_kind
from .lookup import compare_shares, node_at
from .settle import settled

UNATTRIBUTED = "(unattributed)"


@dataclass
class Trace:
    """``samples``: tid, stack_idx (null: none), weight; ``stacks``: tid, stack_idx, prefix, frame_idx; ``frames``: tid, frame_idx, label, library."""

    samples: DataFrame
    stacks: DataFrame
    frames: DataFrame


def frames_of(frame: DataFrame, func: DataFrame, string: DataFrame, resource: DataFrame, libs: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """The star lookup: frame to function to name, and to resource to library. ``symbols`` (as in ``symbolized``) resolves addresses."""
    f = frame.join(func, ["tid", "func_idx"]).join(string.withColumnRenamed("value", "_name"), ["tid", "name_idx"], "left")
    f = f.join(resource, ["tid", "resource_idx"], "left").join(libs.select("lib_idx", F.col("name").alias("library")), "lib_idx", "left")
    label = frame_label(F.col("_name"), F.col("address"))
    if symbols is not None:
        f = symbolized(f, symbols, "_symbol")
        label = F.coalesce("_symbol", label)
    return f.select("tid", "frame_idx", label.alias("label"), "library")


def symbolized(frames: DataFrame, symbols: DataFrame, out: str = "symbol") -> DataFrame:
    """Adds the name of the function that holds each ``address`` of a ``library``, null if none does.

    ``symbols`` has ``library, address, name`` and may have ``size``: a function without one, or of none, reaches to the next of its library. The search is by
    position in the ordered union of addresses and functions. A null library is a library of its own.
    """
    known = F.coalesce("library", F.lit("\0"))
    own = symbols.select(known.alias("_of"), F.col("address").cast("long").alias("start"), F.col("name").alias("kind"), (F.col("size") if "size" in symbols.columns else F.lit(None)).cast("long").alias("_size")).filter("start is not null")
    after = F.min("start").over(Window.partitionBy("_of").orderBy("start").rangeBetween(1, Window.unboundedFollowing))
    end = F.when(F.col("_size") > 0, F.col("start") + F.col("_size")).otherwise(F.coalesce(after, F.lit((1 << 63) - 1)))
    spans = own.withColumn("end", end)
    found = node_at(frames.withColumn("_of", known), spans, "_of", "address")
    return found.withColumnRenamed("node_kind", out).drop("_of", "node_start", "node_end")


def load(spark: SparkSession, path: str) -> Trace:
    """Profiles as JSON documents, gzip by their name's ending, a file each; columns of a thread's tables become rows."""
    from pyspark.sql import types as T

    raw = spark.read.option("multiLine", True).json(path, schema=T._parse_datatype_string("libs array<struct<name:string,path:string,debugPath:string,debugId:string,codeId:string>>, threads array<struct<tid:long,name:string,samples:struct<stack:array<int>,weight:array<long>,time:array<double>>,stackTable:struct<prefix:array<int>,frame:array<int>>,frameTable:struct<address:array<long>,func:array<int>>,funcTable:struct<name:array<int>,resource:array<int>>,resourceTable:struct<lib:array<int>>,stringArray:array<string>>>"))
    thread = raw.select(F.explode("threads").alias("t")).select("t.*")
    rows = lambda index, **columns: thread.select("tid", F.posexplode(F.arrays_zip(*[F.col(c).alias(k) for k, c in columns.items()])).alias(index, "x")).select("tid", index, "x.*")
    absent = lambda c: F.when(F.col(c) >= 0, F.col(c))
    samples = rows("sample_idx", stack_idx="samples.stack", weight="samples.weight").withColumn("weight", F.coalesce("weight", F.lit(1)))
    resource = rows("resource_idx", lib_idx="resourceTable.lib").withColumn("lib_idx", absent("lib_idx"))
    func = rows("func_idx", name_idx="funcTable.name", resource_idx="funcTable.resource").withColumn("resource_idx", absent("resource_idx"))
    libs = raw.select(F.posexplode("libs").alias("lib_idx", "l")).select("lib_idx", "l.name")
    frames = frames_of(rows("frame_idx", address="frameTable.address", func_idx="frameTable.func"), func, rows("name_idx", value="stringArray"), resource, libs)
    return Trace(samples, rows("stack_idx", prefix="stackTable.prefix", frame_idx="stackTable.frame"), frames)


def threads_of(profiles: DataFrame, profile: str = "profile") -> DataFrame:
    """A row for each thread of JSON profiles: ``tid``, ``libs`` (names), and ``thread``, the whole thread as VARIANT, fields that nothing here knows included.

    Profiles that aren't JSON, and null ones, have no threads; a thread without a number has the null one.
    """
    v = profiles.select(F.try_parse_json(profile).alias("_v"))
    libs = F.transform(F.try_variant_get("_v", "$.libs", "array<variant>"), lambda x: F.try_variant_get(x, "$.name", "string"))
    each = v.select(libs.alias("libs"), F.explode(F.try_variant_get("_v", "$.threads", "array<variant>")).alias("thread"))
    return each.select(F.try_variant_get("thread", "$.tid", "long").alias("tid"), "libs", "thread")


def from_threads(threads: DataFrame) -> Trace:
    """The normalised tables of threads as VARIANT. Tables and columns that a profile lacks are empty; labels and libraries are looked up inside the row, without joins."""
    own = lambda path, kind="array<int>": F.try_variant_get("thread", path, kind)
    at = lambda values, i: F.when(i >= 0, F.get(values, i))

    def rows(index: str, arrays: dict[str, Column], make) -> DataFrame:
        """A row for each element of the first array; the arrays are read from the thread once."""

        def each(s: Column) -> Column:
            n = F.greatest(F.coalesce(F.size(s[next(iter(arrays))]), F.lit(0)), F.lit(0))
            return F.transform(F.filter(F.sequence(F.lit(0), n), lambda i: i < n), lambda i: F.struct(*[c.alias(k) for k, c in make(s, i).items()]))

        listed = let(F.struct(*[c.alias(k) for k, c in arrays.items()]), each)
        return threads.select("tid", F.posexplode(listed).alias(index, "_x")).select("tid", index, "_x.*")

    samples = rows("sample_idx", {"stack": own("$.samples.stack"), "weight": own("$.samples.weight", "array<long>")}, lambda s, i: {"stack_idx": F.get(s["stack"], i), "weight": F.coalesce(F.get(s["weight"], i), F.lit(1).cast("long"))})
    stacks = rows("stack_idx", {"frame": own("$.stackTable.frame"), "prefix": own("$.stackTable.prefix")}, lambda s, i: {"prefix": F.get(s["prefix"], i), "frame_idx": F.get(s["frame"], i)})
    tables = {
        "func": own("$.frameTable.func"), "address": own("$.frameTable.address", "array<long>"), "name": own("$.funcTable.name"), "resource": own("$.funcTable.resource"),
        "lib": own("$.resourceTable.lib"), "strings": own("$.stringArray", "array<string>"), "libs": F.col("libs"),
    }
    label = lambda s, i: frame_label(at(s["strings"], at(s["name"], F.get(s["func"], i))), F.get(s["address"], i))
    library = lambda s, i: at(s["libs"], at(s["lib"], at(s["resource"], F.get(s["func"], i))))
    return Trace(samples, stacks, rows("frame_idx", tables, lambda s, i: {"label": label(s, i), "library": library(s, i)}))


def load_variant(spark: SparkSession, path: str) -> Trace:
    """As ``load``, for profiles that have more or fewer tables and fields than it expects."""
    return from_threads(threads_of(spark.read.option("wholetext", True).text(path), "value"))


def _pct(part: Column, total: Column) -> Column:
    return F.when(total == 0, 0.0).otherwise(100.0 * part / total)


def _with_total(df: DataFrame, t: Trace) -> DataFrame:
    """Every row with the weight of all samples, those without a stack too (a one-row side)."""
    return df.join(F.broadcast(t.samples.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("total"))))


def _leaves(t: Trace) -> DataFrame:
    return t.samples.join(t.stacks, ["tid", "stack_idx"]).join(t.frames, ["tid", "frame_idx"]).select("label", "library", "weight")


def paths(t: Trace) -> DataFrame:
    """``tid, stack_idx, frames``: frame indexes from the leaf to the root.

    Every round doubles what is known of each path, so the number of joins is the logarithm of the depth. A path has as many
    frames as its thread has stacks at most, which ends parents that run in circles.
    """
    sizes = t.stacks.groupBy("tid").agg(F.count("*").alias("_most"))
    state = t.stacks.join(sizes, "tid").select("tid", "stack_idx", "_most", F.col("prefix").alias("_next"), F.array("frame_idx").alias("frames"))
    while True:
        # written, not cached: a lost executor costs nothing, and the last round's plan doesn't hold those before
        state = settled(state)
        if not state.filter("_next is not null").take(1):
            return state.select("tid", "stack_idx", "frames")
        above = state.select("tid", F.col("stack_idx").alias("_next"), F.col("_next").alias("_after"), F.col("frames").alias("_more"))
        grown = state.join(above, ["tid", "_next"], "left").withColumn("frames", F.coalesce(F.concat("frames", "_more"), "frames"))
        full = F.size("frames") >= F.col("_most")
        state = grown.select("tid", "stack_idx", "_most", F.when(~full, F.col("_after")).alias("_next"), F.slice("frames", F.lit(1), F.col("_most").cast("int")).alias("frames"))


def labelled_paths(t: Trace) -> DataFrame:
    """As ``paths``, with labels, leaf first."""
    each = paths(t).select("tid", "stack_idx", F.posexplode("frames").alias("i", "frame_idx")).join(t.frames, ["tid", "frame_idx"])
    row = each.groupBy("tid", "stack_idx").agg(F.sort_array(F.collect_list(F.struct("i", "label"))).alias("x"))
    return row.select("tid", "stack_idx", F.col("x.label").alias("frames"))


def _hot(counts: DataFrame, t: Trace) -> DataFrame:
    full = _with_total(counts, t)
    incl, own = _pct(F.col("incl_samples"), F.col("total")), _pct(F.col("self_samples"), F.col("total"))
    return full.select("label", "incl_samples", incl.alias("incl_pct"), "self_samples", own.alias("self_pct")).withColumn("row_kind", row_kind(F.col("label"), F.col("self_pct"), F.col("incl_pct")))


def hot_leaves(t: Trace, n: int | None = None) -> DataFrame:
    """Weight by leaf label; the first n by weight, then label."""
    counts = _leaves(t).groupBy("label").agg(F.sum("weight").alias("self_samples")).withColumn("incl_samples", F.col("self_samples"))
    found = _hot(counts, t)
    return found if n is None else found.orderBy(F.desc("incl_samples"), "label").limit(n)


def hot_inclusive(t: Trace, n: int | None = None) -> DataFrame:
    """Weight by label anywhere in the stack; a frame counts once per sample, two frames with one label twice."""
    weights = t.samples.groupBy("tid", "stack_idx").agg(F.sum("weight").alias("weight"))
    each = paths(t).select("tid", "stack_idx", F.explode(F.array_distinct("frames")).alias("frame_idx")).join(weights, ["tid", "stack_idx"]).join(t.frames, ["tid", "frame_idx"])
    incl = each.groupBy("label").agg(F.sum("weight").alias("incl_samples"))
    own = _leaves(t).groupBy("label").agg(F.sum("weight").alias("self_samples"))
    found = _hot(incl.join(own, "label", "left").withColumn("self_samples", F.coalesce("self_samples", F.lit(0))), t)
    return found if n is None else found.orderBy(F.desc("incl_samples"), "label").limit(n)


def library_distribution(t: Trace) -> DataFrame:
    stacked = t.samples.join(t.stacks, ["tid", "stack_idx"], "left").join(t.frames, ["tid", "frame_idx"], "left")
    counts = stacked.groupBy(F.coalesce("library", F.lit(UNATTRIBUTED)).alias("library")).agg(F.sum("weight").alias("samples"))
    return _with_total(counts, t).select("library", "samples", _pct(F.col("samples"), F.col("total")).alias("pct"))


def category(label: Column, categories: list[tuple[str, list[str]]]) -> Column:
    """The first category one of whose expressions is found in the label, else ``unknown``."""
    out = F.when(F.lit(False), "")
    for name, patterns in categories:
        hit = F.lit(False)
        for p in patterns:
            hit |= label.rlike(p)
        out = out.when(hit, name)
    return out.otherwise("unknown")


def read_categories(toml: str) -> list[tuple[str, list[str]]]:
    """From ``[[categories]]`` tables with ``name`` and ``patterns``."""
    import tomllib

    parsed = tomllib.loads(toml)
    if not isinstance(parsed.get("categories"), list):
        raise ValueError("there is no [[categories]]")
    out = []
    for c in parsed["categories"]:
        if "name" not in c or "patterns" not in c:
            raise ValueError("a category lacks its name or patterns")
        out.append((c["name"], [p for p in c["patterns"] if isinstance(p, str)]))
    return out


def category_rollup(t: Trace, categories: list[tuple[str, list[str]]]) -> DataFrame:
    """All configured categories in their order, then others by weight: ``ord, category, samples, pct, distinct_funcs``."""
    own = _leaves(t).withColumn("category", category(F.col("label"), categories)).groupBy("category").agg(F.sum("weight").alias("samples"), F.count_distinct("label").alias("distinct_funcs"))
    listed = own.sparkSession.createDataFrame([(c, i) for i, (c, _) in enumerate(categories)], "category string, ord int")
    full = F.broadcast(listed).join(own, "category", "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = _with_total(full.select(F.coalesce("ord", F.lit(len(categories))).alias("ord"), "category", zero("samples").alias("samples"), zero("distinct_funcs").alias("distinct_funcs")), t)
    return rows.select("ord", "category", "samples", _pct(F.col("samples"), F.col("total")).alias("pct"), "distinct_funcs").orderBy("ord", F.desc("samples"), "category")


def folded_stacks(t: Trace) -> DataFrame:
    """Weight by whole stack, root first, and the stack as text: names joined by semicolons, those inside names as colons."""
    weights = t.samples.groupBy("tid", "stack_idx").agg(F.sum("weight").alias("weight"))
    stacks = labelled_paths(t).join(weights, ["tid", "stack_idx"]).groupBy(F.reverse("frames").alias("stack")).agg(F.sum("weight").alias("samples"))
    text = F.array_join(F.transform("stack", lambda x: F.replace(x, F.lit(";"), F.lit(":"))), ";")
    return stacks.withColumn("folded", F.concat(text, F.lit(" "), F.col("samples").cast("string")))


def matching_stacks(t: Trace, pattern: str, n: int | None = None) -> DataFrame:
    """Whole stacks, leaf first, in which a frame matches: ``frames, samples, pct``."""
    weights = t.samples.groupBy("tid", "stack_idx").agg(F.sum("weight").alias("weight"))
    own = labelled_paths(t).filter(F.exists("frames", lambda x: x.rlike(pattern))).join(weights, ["tid", "stack_idx"])
    found = _with_total(own.groupBy("frames").agg(F.sum("weight").alias("samples")), t).select("frames", "samples", _pct(F.col("samples"), F.col("total")).alias("pct"))
    return found if n is None else found.orderBy(F.desc("samples"), "frames").limit(n)


def compare(before: Trace, after: Trace, n: int) -> DataFrame:
    """The n largest changes of leaf shares; each side is cut to its 4 n hottest labels first."""
    rows = compare_shares(hot_leaves(before, 4 * n), hot_leaves(after, 4 * n), "label", "self_pct")
    return rows.orderBy(F.desc(F.abs("delta_pct")), "label").limit(n)
