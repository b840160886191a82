"""Every query against its SQL in DuckDB, over the smallest tables."""

import duckdb
import pytest

from quadloom import catalog

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels"]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def shown(v):
    return "-" if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    found = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(got.columns)
    order = sorted(columns)
    want = sorted(tuple(shown(r[columns.index(c)]) for c in order) for r in found.fetchall())
    assert sorted(tuple(shown(r[c]) for c in order) for r in got.collect()) == want


def test_every_query_has_sql():
    assert catalog.queries().keys() == catalog.oracle_sql().keys()


def test_partition_iris_are_made_of_counts_that_read_each_table_once(spark):
    """Of the tables where no rows of lineitem share a key."""
    got = catalog.queries()["void_partition_iris"](spark, "/root/testdata/sf0.1")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in got and got.count("parquet") == 8
