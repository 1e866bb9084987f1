"""Each registered query of the engine against its SQL, and the entry."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from suffixspark.plans import catalog


@pytest.fixture(scope="module")
def tables(sf):
    import os

    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, sf, tables, name):
    got = catalog.queries()[name](spark, sf)
    cursor = tables.execute(catalog.oracle_sql()[name])
    names = sorted(c[0] for c in cursor.description)
    assert sorted(got.columns) == names
    place = [[c[0] for c in cursor.description].index(n) for n in names]
    want = sorted(repr([r[i] for i in place]) for r in cursor.fetchall())
    assert sorted(repr(list(r)) for r in got.select(*names).collect()) == want


def test_each_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(entry_module.queries())
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
