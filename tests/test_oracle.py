"""Every registered query with SQL gives the same rows as DuckDB; the others give rows."""

import duckdb
import pytest
from compare import TABLES, duck_result, spark_result

from spherecube.catalog import oracle_sql, queries

QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return connection


def test_no_sql_without_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    if name not in SQL:
        assert df.count() > 0
        return
    names, got = spark_result(df)
    expected_names, expected = duck_result(duck, SQL[name])
    assert names == expected_names
    assert len(got) == len(expected) > 0
    assert got == expected
