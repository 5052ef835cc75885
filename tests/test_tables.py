"""Percentiles on small and on tied, skewed and empty groups, against the built-in exact ones."""

import random

import pytest
from pyspark.sql import functions as F

from lodestat.operators import tables as O

PS = [0.0, 0.25, 0.5, 0.9, 0.95, 1.0]


@pytest.fixture(scope="module")
def values(spark):
    r = random.Random(5)
    rows = [(None, 4.0), ("none", None), ("one", 7.0)]
    for n in (2, 3, 5, 10, 19, 40):
        rows += [(f"n{n}", r.random()) for _ in range(n)]
    rows += [("ties", float(r.randrange(3))) for _ in range(5000)] + [("skewed", r.paretovariate(0.5)) for _ in range(30000)]
    return spark.createDataFrame(rows, "g string, v double").repartition(8)


def same(a, b):
    return (a is None and b is None) or len(a) == len(b) and all(abs(x - y) <= 1e-9 * max(1.0, abs(y)) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("accuracy", [10000, 200])
def test_percentiles_by_group(values, accuracy):
    want = {r.g: r.q for r in values.where("v is not null").groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, PS))).alias("q")).collect()}
    got = {r.g: r.q for r in O.percentiles(values, ["g"], "v", PS, accuracy).collect()}
    assert got.keys() == want.keys()
    assert all(same(got[g], want[g]) for g in want), [(g, got[g], want[g]) for g in want if not same(got[g], want[g])][:2]


def test_percentiles_of_all_and_of_nothing(values):
    want = values.agg(F.percentile("v", F.array(*map(F.lit, PS))).alias("q")).first().q
    assert same(O.percentiles(values, [], "v", PS).first().q, want)
    out = O.agg_percentiles(values.where("false"), [], "v", PS, F.count("v").alias("n")).collect()
    assert [tuple(r) for r in out] == [(0, None)]
    by = {r.g: r for r in O.agg_percentiles(values, ["g"], "v", [0.5], F.count("v").alias("n")).collect()}
    assert by["none"].n == 0 and by["none"].q is None and by["one"].q == [7.0] and by[None].q == [4.0]
