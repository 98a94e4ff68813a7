"""Every reference query runs, and equals its SQL in DuckDB, at the smallest size."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    text = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(r[i]) for i in order) for r in rows), sorted(names)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = df.collect()
    if sql := entry.oracle_sql().get(name):
        cur = duck.execute(sql)
        names = [x[0] for x in cur.description]
        assert plain(got, df.columns) == plain(cur.fetchall(), names)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
