"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from tracegauge.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: round(v, 9) + 0.0 if isinstance(v, float) else v
    return sorted(repr(tuple(clean(r[i]) for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    got = con.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(columns)
    assert _rows(df.columns, df.collect()) == _rows(columns, got.fetchall())


#: Sixty models: only its parts are tested (test_operators.py).
SLOW = {"tree_cross_validation"}


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql()) - SLOW))
def test_query_runs(spark, name):
    df = catalog.queries()[name](spark, SF)
    df.write.format("noop").mode("overwrite").save()
    assert df.columns


def test_entry_and_names(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
