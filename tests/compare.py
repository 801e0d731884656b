"""Spark's rows and DuckDB's, as multisets of printed values by column name."""

import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        path += "/*.parquet" if os.path.isdir(path) else ""
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return c


def shown(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return f"{v:.7g}" if isinstance(v, float) else str(v)


def same_as_sql(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got = sorted(tuple(shown(r[c]) or "" for c in sorted(df.columns)) for r in df.collect())
    found = connect(sf_dir).execute(sql)
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(shown(dict(zip(names, r, strict=True))[c]) or "" for c in sorted(names)) for r in found.fetchall())
    assert got == want
