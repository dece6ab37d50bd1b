"""Every query that has SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from folioforge.plans import catalog, details, extras, indexes, library, literals, more

SF = "/root/testdata/sf0.001"
QUERIES = library.QUERIES | literals.QUERIES | more.QUERIES | catalog.QUERIES | extras.QUERIES | indexes.QUERIES | details.QUERIES
SQL = library.SQL | literals.SQL | more.SQL | catalog.SQL | extras.SQL | indexes.SQL | details.SQL


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(SF):
        name = f.removesuffix(".parquet")
        c.execute(f"create view {name} as select * from '{SF}/{f}'")
    return c


def _plain(v):
    if isinstance(v, float):
        return round(v, 8) + 0.0
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, db, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = db.sql(SQL[name])
    assert sorted(want.columns) == columns
    at = [list(want.columns).index(c) for c in columns]
    ours = sorted(repr([_plain(v) for v in r]) for r in got.select(*[f"`{c}`" for c in columns]).collect())
    theirs = sorted(repr([_plain(r[i]) for i in at]) for r in want.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
