"""Every registered query with SQL against DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

from tidewater.plans.catalog import REGISTRY
from tidewater.plans.oracles import ORACLES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if v is not None and not isinstance(v, (str, bool)):
        return round(float(v), 5)
    return v


def rows(names, data):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in at) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, sf, name):
    df = REGISTRY[name](spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.cursor()
    r = cur.execute(ORACLES[name])
    cols = [c[0] for c in r.description]
    assert sorted(cols) == sorted(df.columns)
    assert got == rows(cols, r.fetchall())


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, sf, name):
    assert REGISTRY[name](spark, sf).count() > 0
