"""Every registered query against its SQL on the smallest tables."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as spark_entry
from labelmill.plans.registry import QUERIES

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="driver tables are not here")


@pytest.fixture(scope="module")
def database():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for path in FOLDER.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def test_registry_is_consistent():
    names, oracles = set(spark_entry.queries()), set(spark_entry.oracle_sql())
    assert oracles <= names and set(QUERIES) - oracles == {"logreg_bow"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, database, name):
    df = spark_entry.queries()[name](spark, str(FOLDER))
    order = sorted(df.columns)
    got = sorted(repr(tuple(row)) for row in df.select(*order).collect())
    if name not in spark_entry.oracle_sql():
        assert got
        return
    result = database.execute(spark_entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == order
    places = [columns.index(c) for c in order]
    expected = sorted(repr(tuple(row[i] for i in places)) for row in result.fetchall())
    assert got == expected


def test_entry(spark):
    rows = spark_entry.entry(spark).collect()
    assert {r.split for r in rows} == {"train", "validation"}
    assert all(not math.isnan(r.accuracy) and r.n > 0 for r in rows)
