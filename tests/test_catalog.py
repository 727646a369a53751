"""Every registered query against its SQL, and the shape of the driver contract."""

import duckdb
import pytest

from check import TABLES, rows_of
from poolscout.catalog import REGISTRY

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES.split():
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", [n for n, q in REGISTRY.items() if q.sql is not None])
def test_query_equals_sql(spark, duck, name):
    frame = REGISTRY[name](spark, FOLDER)
    result = duck.execute(REGISTRY[name].sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(frame.columns)
    assert rows_of(frame.columns, [tuple(r) for r in frame.collect()]) == rows_of(names, result.fetchall())


def test_contract():
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert len(contract.queries()) > 100


def test_entry(spark):
    import __spark_entry__ as contract

    rows = contract.entry(spark).collect()
    assert [r["iter"] for r in rows] == sorted(r["iter"] for r in rows)
    assert rows[-1]["top_k_avg"] >= rows[0]["top_k_avg"]
