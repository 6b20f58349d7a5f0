"""Every registered query of the document checks against its SQL."""

import math
import os

import duckdb
import pytest

from inkproof import catalogue, oracle
from inkproof.sources.views import TABLES

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = catalogue.queries(), oracle.oracle_sql()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if hasattr(v, "tzinfo") and v.tzinfo:
        return v.replace(tzinfo=None)
    return v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(([plain(r[i]) for i in order] for r in found), key=repr)


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("the given tables aren't here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def test_each_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())
