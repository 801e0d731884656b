"""Ranks, running sums and ranges against plain Python."""

import random

from pyspark.sql import functions as F

from hanmoto.llm import common


def table(spark, n=700):
    r = random.Random(1)
    rows = [(i if i % 50 else None, r.randint(0, 40), "abc"[min(2, r.randint(0, 9))], r.randint(0, 5)) for i in r.sample(range(-n, n), n)]
    return rows, spark.createDataFrame(rows, "id long, v long, k string, w long").repartition(5).cache()


def test_running_totals(spark):
    rows, df = table(spark)
    for keys in ([], ["k"]):
        got = sorted(((r.id is not None, r.id or 0, r.k, r.v, r.total) for r in common.running_total(df, keys, ["id"], "v", "total").collect()))
        sums, want = {}, []
        for i, v, k, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
            if i is None:
                continue
            want.append((i, k, v))
        base = {}
        for i, v, k, _ in rows:
            if i is None:
                key = k if keys else ""
                base[key] = base.get(key, 0) + v
        ordered = {(i, k, v): t for there, i, k, v, t in got if there}
        sums = dict(base)
        for i, k, v in want:
            key = k if keys else ""
            assert ordered[(i, k, v)] == sums.get(key, 0)
            sums[key] = sums.get(key, 0) + v


def test_global_ranks(spark):
    rows, df = table(spark)
    got = sorted((r.rank, r.w, r.id) for r in common.global_rank(df.filter("id is not null"), [F.col("w").asc(), F.col("id").desc()], "rank").collect())
    want = sorted(((w, -i) for i, _, _, w in rows if i is not None))
    assert [(w, -i) for _, w, i in got] == want and [r for r, _, _ in got] == list(range(len(want)))


def test_ranges_ascend_and_keep_equals_together(spark):
    _, df = table(spark)
    seen = {}
    for r in common.range_of(df, "v", "part", 8).collect():
        assert seen.setdefault(r.v, r.part) == r.part
    order = [seen[v] for v in sorted(seen)]
    assert order == sorted(order) and len(set(order)) > 3
    assert {r.part for r in common.range_of(df.filter("id is null"), "id", "part").collect()} == {-1}
    assert common.range_of(df.limit(0), "id", "part").count() == 0


def there(spark, df):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0]).getParent()
    return lambda: path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def test_scratch_tables_go_and_kept_ones_stay(spark):
    with common.scratch(spark) as keep:
        gone = there(spark, common.materialize(spark.range(3), "gone"))
        with common.scratch(spark) as inner:
            soon = there(spark, common.materialize(spark.range(4), "soon"))
            own = inner(spark.range(5), "own")
        assert not soon() and own.count() == 5 and gone()
        kept = keep(spark.range(6), "kept")
    assert not gone() and there(spark, kept)() and kept.count() == 6


def test_free_names():
    assert common.free_name("n", ["a"]) == "n" and common.free_name("n", ["N", "n_"]) == "n__"
