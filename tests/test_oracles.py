"""Every registered query of the engine against its SQL in DuckDB, and a run of those without SQL."""

import glob
import math
import os

import duckdb
import pytest

from lodestat import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return (0, "")
    if isinstance(x, bool):
        return (1, x)
    if isinstance(x, (int, float)):
        return (2, round(float(x), 5))
    return (3, str(x))


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    got = df.collect()
    assert got
    if sql := catalog.oracle_sql().get(name):
        want = duck.execute(sql)
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(df.columns)
        a, b = rows(df.columns, got), rows(columns, want.fetchall())
        assert len(a) == len(b)
        bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y and not all(p == q or p[0] == q[0] == 2 and abs(p[1] - q[1]) < 1e-4 for p, q in zip(x, y, strict=True))]
        assert not bad, bad[:3]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
