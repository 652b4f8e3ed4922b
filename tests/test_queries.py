"""Every query with SQL, against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from clauseworks.plans import catalogue, oracle

DATA = os.environ.get("CLAUSEWORKS_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def _plain(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    one = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(one(r[k]) for k in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(oracle.sql()))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    want = duck.execute(oracle.sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert _plain([tuple(r) for r in df.collect()], df.columns) == _plain(want.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(oracle.sql())))
def test_query_without_sql_runs(spark, name):
    assert entry.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
