"""What the operators share: the shared folder, written tables, distributed ranks and running sums."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word: a run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
#: Range boundaries asked for at most; the boundary list travels inside the plan, so it must stay small.
MAX_RANGES = 4096


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``.

    Only where the setting is absent (local tests) a temporary folder is made and remembered in the session.
    """
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not there:
        there = "file://" + tempfile.mkdtemp(prefix="hanmoto-shared-")
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


_open: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("open", default=None)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables written inside are deleted at the end, but for those written by the function that this gives; an enclosing block deletes these."""
    outer, inner = _open.get(), []
    token = _open.set(inner)

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = materialize(df, name)
        path = inner.pop()
        if outer is not None:
            outer.append(path)
        return out

    try:
        yield keep
    finally:
        _open.reset(token)
        remove(spark, inner)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Deletes written tables that nothing reads any more, in whatever store they are."""
    jvm = spark.sparkContext._jvm
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (inner := _open.get()) is not None:
        inner.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: lineage is cut there, and lost executors lose nothing."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with ``_`` added until no column is called so (in any case of letters)."""
    there = {c.lower() for c in taken}
    while name.lower() in there:
        name += "_"
    return name


def words(text: Column) -> Column:
    """All words of a text; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def range_of(df: DataFrame, column: str, out: str, n: int | None = None) -> DataFrame:
    """Adds ``out``: the number of the range of an integer column that holds the row, ascending, null in range -1.

    Equal values share a range. The boundaries are quantiles of all rows, to within a fifth of a range.
    """
    n = min(MAX_RANGES, n or 4 * tasks(df.sparkSession))
    cuts = sorted(set(df.select(column).approxQuantile(column, [i / n for i in range(1, n)], 0.2 / n)))
    splits = [float("-inf"), *cuts, float("inf")]
    if len(splits) < 3:
        splits.insert(1, 0.0)
    df = df.withColumn("_of", F.coalesce(F.col(column).cast("double"), F.lit(float("nan"))))
    df = Bucketizer(splits=splits, inputCol="_of", outputCol="_at", handleInvalid="keep").transform(df)
    return df.withColumn(out, F.when(F.col(column).isNull(), -1).otherwise(F.col("_at").cast("int"))).drop("_of", "_at")


def running_total(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows that come before, in ascending ``order``, among rows with equal ``keys``.

    Nulls come first. Rows are cut into hash slices (by the order columns), sorted and summed within a slice only after the slice
    itself was placed by a range boundary on the first order column, so that neither a key with most rows nor an
    unkeyed total ends up in a single task. The first order column must be an integer. ``df`` is read several times and so must be
    a written table. Rows that tie on ``order`` get some order among themselves.
    """
    ranged = range_of(df, order[0], "_range")
    sums = ranged.groupBy(*keys, "_range").agg(F.sum(value).alias("_sum"))
    over = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"), F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*keys, "_range").orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("_local", F.coalesce(F.sum(value).over(within), F.lit(0)))
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return local.join(bases, same).withColumn(out, F.col("_local") + F.col("_base")).drop("_local", "_base", "_r", "_range", *[f"_k{i}" for i in range(len(keys))])


def global_rank(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Adds ``out``: the row's number from 0 in the whole table's order, without gathering rows: a sort, then one offset a partition."""
    placed = materialize(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_id", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    rank = F.col("_base") + F.col("_id").bitwiseAND((1 << 33) - 1)
    return placed.join(bases, part == F.col("_part")).withColumn(out, rank).drop("_id", "_part", "_base")
