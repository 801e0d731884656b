"""Every registered query of the engine against its SQL, on the driver's smallest tables."""

import os

import pytest

from hanmoto.plans import queries

from .compare import same_as_sql

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    same_as_sql(spark, queries.QUERIES[name], queries.SQL[name], SF)


def test_queries_without_sql(spark):
    rows = queries.parse_corpus(spark, SF).collect()
    assert len(rows) == 200 and all(r.n_nodes >= 5 and r.n_diagnostics == 0 for r in rows)
    assert {r.kind for r in queries.node_counts(spark, SF).collect()} >= {"ruby", "bouten", "gaiji", "containerOpen", "containerClose", "pageBreak", "doubleRuby", "tateChuYoko"}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())
