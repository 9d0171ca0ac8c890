"""Registered SQL of the corpus operators against DuckDB on the same tables."""

import os

import duckdb
import pytest

from tidewater.llm import register

SQL = register.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "pages"):
        p = f"{sf}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    df = register.queries()[name](spark, sf)
    cur = c.execute(SQL[name])
    cols = [x[0] for x in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(cur.fetchall(), key=repr)
    assert sorted((tuple(r) for r in df.select(*cols).collect()), key=repr) == want
    assert want
