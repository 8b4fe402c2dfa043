"""Every query of the library against its SQL over the same tables."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_queries import TABLES, compare
from queries import apply, clean, history, keys, mart, sources, transform

SF = "/root/testdata/sf0.001"
LIBRARY = {name for group in (apply, clean, history, keys, mart, sources, transform) for name in group.QUERIES}


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return connection


@pytest.mark.parametrize("name", sorted(LIBRARY))
def test_query_agrees_with_sql(spark, db, name):
    df = queries()[name](spark, SF)
    rows = df.collect()
    assert compare(rows, df.columns, db.execute(oracle_sql()[name])) == ""


def test_every_query_has_sql():
    assert LIBRARY <= set(queries()) and LIBRARY <= set(oracle_sql())


def test_entry(spark):
    assert entry(spark).count() > 0
