"""Every query with an SQL equivalent agrees with it on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as catalog
from conftest import SMALL

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows(columns, table):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in table)


def test_keys():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, db, name):
    df = catalog.queries()[name](spark, SMALL)
    cursor = db.execute(catalog.oracle_sql()[name])
    expected = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(expected)
    assert rows(df.columns, df.collect()) == rows(expected, cursor.fetchall())


def test_entry(spark):
    assert catalog.entry(spark).count() > 0
