"""Each query beside its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from plexgraph.plans import graph_queries, more_queries, source_queries  # noqa: F401 - add their queries
from plexgraph.plans.queries import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, float):
        return f"{value:.6g}"
    return value.isoformat() if hasattr(value, "isoformat") else str(value)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.sql(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in SQL:
        expected = duck.sql(SQL[name])
        assert sorted(expected.columns) == columns
        at = [expected.columns.index(c) for c in columns]
        assert rows == sorted(tuple(plain(r[i]) for i in at) for r in expected.fetchall())
