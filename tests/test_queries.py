"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_point
from bindery.plans.oracles import ORACLES
from bindery.plans.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

duckdb = pytest.importorskip("duckdb")
if not os.path.isdir(SF_DIR):
    pytest.skip("no test tables", allow_module_level=True)


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return connection


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(row[i]) for i in order) for row in rows)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, database, name):
    result = entry_point.queries()[name](spark, SF_DIR)
    expected = database.execute(entry_point.oracle_sql()[name])
    columns = [d[0] for d in expected.description]
    assert sorted(result.columns) == sorted(columns)
    got = rows_of(result.columns, result.collect())
    assert got and got == rows_of(columns, expected.fetchall())


def test_entry(spark):
    result = entry_point.entry(spark)
    assert result.columns == ["bundle", "shard", "n_files", "n_bytes", "sha"]
    assert result.count() > 0
