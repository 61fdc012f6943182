"""Every query with an oracle against DuckDB, at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tessel.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def rows(values, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([list(v[i]) if isinstance(v[i], list | tuple) else v[i] for i in order]) for v in values)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_oracle(spark, db, name):
    got = catalog.QUERIES[name](spark, SF)
    want = db.sql(catalog.ORACLES[name])
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_oracle_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
