"""Every registered query against its SQL check, on whole tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from fablens.plans.catalog import CHECKS, QUERIES
from tools.check import TABLES, rows_of


@pytest.fixture(scope="module")
def db(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_matches_sql(spark, db, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    want = db.sql(CHECKS[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(CHECKS)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    result = entry.entry(spark)
    assert result.columns == ["hour", "critical", "errors", "non_urgent"]
    assert result.count() > 0


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(CHECKS) <= set(entry.oracle_sql()) and set(QUERIES) <= set(entry.queries())
