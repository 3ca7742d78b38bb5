"""Queries against their SQL on the smallest tables, if they are here."""

import math
import os

import pytest

import __spark_entry__ as entry_points

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.12g}")
    return v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    db = duckdb.connect()
    for f in os.listdir(FOLDER):
        db.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    return db


@pytest.mark.parametrize("name", sorted(k for k in entry_points.oracle_sql() if not k.startswith("op")))
def test_query(spark, duck, name):
    found = entry_points.queries()[name](spark, FOLDER)
    expected = duck.sql(entry_points.oracle_sql()[name])
    assert sorted(found.columns) == sorted(expected.columns)
    order = sorted(found.columns)
    a = sorted((tuple(plain(r[c]) for c in order) for r in found.collect()), key=repr)
    b = sorted((tuple(plain(r[expected.columns.index(c)]) for c in order) for r in expected.fetchall()), key=repr)
    assert a == b


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
