import os

import pytest

import __spark_entry__ as registered

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_every_query_has_sql():
    assert list(registered._own_queries()) == list(registered._own_sql())
    assert set(registered.oracle_sql()) <= set(registered.queries())


@needs_tables
def test_flagship(spark):
    rows = registered.entry(spark).collect()
    assert sum(r["page_rank"] for r in rows) == pytest.approx(1.0)
    assert [r["page_rank"] for r in rows] == sorted((r["page_rank"] for r in rows), reverse=True)


@needs_tables
@pytest.mark.parametrize("name", ["graph_edges_last_wins", "endpoint_integrity", "out_weight_share", "dangling_mass"])
def test_against_sql(spark, name):
    import duckdb

    database = duckdb.connect()
    for table in ("customer", "supplier", "orders", "lineitem", "events"):
        database.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    result = database.sql(registered.oracle_sql()[name])
    frame = registered.queries()[name](spark, FOLDER).select(*result.columns)
    assert sorted(tuple(r) for r in frame.collect()) == sorted(result.fetchall())
