"""Every registered query against its SQL, over the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as driver
from auditloom.plans import oracles, registry
from check import TABLES, digest

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = registry.QUERIES
SQL = oracles.all_sql()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


def test_all_are_registered():
    assert set(QUERIES) <= set(driver.queries())
    assert set(SQL) <= set(driver.oracle_sql())


def test_entry(spark):
    assert driver.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, db, name):
    frame = QUERIES[name](spark, SF_DIR)
    columns = sorted(frame.columns)
    ours = [tuple(r) for r in frame.select(*[f"`{c}`" for c in columns]).collect()]
    result = db.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    theirs = [tuple(row[names.index(c)] for c in columns) for row in result.fetchall()]
    assert digest(ours) == digest(theirs), Counter(map(repr, ours)) - Counter(map(repr, theirs))
    assert ours
