"""Every query beside its SQL in DuckDB."""

import datetime as dt
import math
import os

import duckdb
import pytest

from millrace.plans import catalogue, scenarios  # noqa: F401 - both register queries


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None)
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck(sf):
    made = duckdb.connect()
    made.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(sf):
        made.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf}/{name}'")
    return made


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sf, duck, name):
    got = catalogue.queries()[name](spark, sf)
    rows = got.collect()
    assert len(set(got.columns)) == len(got.columns)
    if name not in catalogue.oracle_sql():
        assert rows
        return
    want = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert rows_of(got.columns, rows) == rows_of(names, want.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["event_id", "k", "ts"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
