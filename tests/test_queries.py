"""Every query with SQL gives the rows that DuckDB gives."""

import math

import duckdb
import pytest

from tracewell.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows, columns):
    order = sorted(columns)
    clean = lambda x: None if isinstance(x, float) and math.isnan(x) else round(x, 6) if isinstance(x, float) else x
    return sorted(repr(tuple(clean(r[columns.index(c)]) for c in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.sql(registry.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), list(want.columns))


def test_every_query_has_sql():
    assert registry.QUERIES.keys() == registry.ORACLES.keys()


def test_the_entry_points(spark):
    import __spark_entry__ as entry

    assert registry.QUERIES.keys() <= entry.queries().keys() and entry.oracle_sql().keys() <= entry.queries().keys()
    assert entry.entry(spark).count() > 0
