"""Queries with SQL against that SQL, on the small tables."""

import duckdb
import pytest

from millrace.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    rows = sorted(want.fetchall())
    assert rows and sorted(tuple(r[c] for c in columns) for r in queries.queries()[name](spark, sf).collect()) == rows
