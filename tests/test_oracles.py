"""Every registered query of the library against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest
from conftest import DATA

from chronoplate.plans import catalog


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, list | tuple):
        return tuple(plain(v) for v in value)
    return value


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, str(type(v)), str(v)) for v in r))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{DATA}/{file}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    result = duck.execute(catalog.ORACLES[name])
    theirs = [d[0] for d in result.description]
    assert sorted(theirs) == columns
    got = ordered(tuple(plain(r[c]) for c in columns) for r in df.collect())
    want = ordered(tuple(plain(r[theirs.index(c)]) for c in columns) for r in result.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0
