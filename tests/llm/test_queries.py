"""Registered queries against their SQL, and the pipeline against brute force, on the driver's small tables."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hanmoto.llm import queries
from hanmoto.llm.common import materialize
from hanmoto.llm.near_copies import jaccard, read_set, shingle_set

from ..compare import TABLES, same_as_sql
from . import edge

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    same_as_sql(spark, queries.QUERIES[name], queries.SQL[name], SF)


def test_every_operator_has_a_query():
    assert [n for n in range(1, 14) if not any(q.startswith(f"op{n}_") for q in queries.QUERIES)] == []


def similar_groups(texts):
    """For each id the smallest one that is reached by links of similarity 0.8 over five-word shingles, every pair compared."""
    sets = {i: read_set(shingle_set(t)) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if small >= 0.8 * large and jaccard(sets[a], sets[b]) >= 0.8:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        seen[name] = docs = materialize(out, "stage")
        if name != "packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    before = {r.doc_id: r.text for r in seen["line dedup"].collect()}
    kept = {r.doc_id for r in seen["near-copy removal"].collect()}
    assert kept == {i for i, g in similar_groups(before).items() if i == g}
    mixed = [(r.doc_id, r.text) for r in seen["mixing"].collect()]
    tokens = {}
    for r in seen["packing"].collect():
        tokens.setdefault(r.doc_id, []).append((r.length, r.doc_tokens))
    assert {i for i, _ in mixed} == set(tokens) and {i for i, _ in mixed} <= kept
    for i, n in Counter(i for i, _ in mixed).items():
        assert sum(length for length, _ in tokens[i]) == n * tokens[i][0][1]


def test_two_pipeline_results_live_side_by_side(spark, tmp_path):
    rows = [(i, " ".join(f"w{(i * 31 + k * (7 + i)) % 997}" for k in range(40)) + f"\nline {i}", "en", f"s{i % 3}", 0) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    first, second = corpus_pipeline.run(spark, str(tmp_path)), corpus_pipeline.run(spark, str(tmp_path))
    assert second.count() == first.count() > 0
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, second.collect()))


def test_pipeline_stages_bear_awkward_rows(spark):
    docs = spark.createDataFrame(edge.rows(), edge.SCHEMA).withColumn("n_lines", F.lit(7)).withColumn("n_dropped", F.lit("d")).repartition(3)
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = materialize(stage(spark, rows, SF), "stage")
            if name != "packing":
                assert out.columns == docs.columns
                assert out.filter("n_lines <> 7 or n_dropped <> 'd' or label <> 'x'").isEmpty()
                rows = out
        assert out.isEmpty() == rows.isEmpty()


def test_host_verdicts_match_sql_where_they_reject(spark, tmp_path):
    good = " ".join(f"w{i}" for i in range(40))
    hosts = {"bad": (95, 100), "mixed": (50, 100), "small bad": (3, 3), "fine": (1, 200), None: (70, 80)}
    rows = [(1000 * h + i, "short" if i < f else good + f" {h} {i}", "en", s, 0) for h, (s, (f, n)) in enumerate(hosts.items()) for i in range(n)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    sql = queries.SQL["op2_quality_rules"]
    for name in TABLES:
        if name != "documents":
            os.symlink(f"{SF}/{name}.parquet", f"{tmp_path}/{name}.parquet")
    same_as_sql(spark, queries.QUERIES["op2_quality_rules"], sql, str(tmp_path))
    rejected = queries.QUERIES["op2_quality_rules"](spark, str(tmp_path)).filter("not base_failed and not kept")
    assert {r.doc_id // 1000 for r in rejected.collect()} == {0, 4}
