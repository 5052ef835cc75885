"""Named conditions and measures, so that users add their own without touching the engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from lodestat.functions.scalars import count_true

CONDITIONS: dict[str, Callable[[], Column]] = {}
METRICS: dict[str, Callable[[], Column]] = {}
BINS: dict[str, Callable[[], Column]] = {}


def register_condition(name: str, make: Callable[[], Column]) -> None:
    """make() gives a boolean column; null stands for unknown."""
    CONDITIONS[name] = make


def register_metric(name: str, make: Callable[[], Column]) -> None:
    """make() gives an aggregate."""
    METRICS[name] = make


def register_bin(name: str, make: Callable[[], Column]) -> None:
    """make() gives a label to group by."""
    BINS[name] = make


def evaluate(df: DataFrame, by: list[str], conditions: list[str], metrics: list[str], bins: tuple[str, ...] = ()) -> DataFrame:
    """Rows that pass each condition, and the measures, by group and bin, in one aggregate."""
    return df.groupBy(*by, *(BINS[b]().alias(b) for b in bins)).agg(*(count_true(CONDITIONS[c]()).alias(c) for c in conditions), *(METRICS[m]().alias(m) for m in metrics))


def register_sql(spark: SparkSession) -> None:
    """wilson_lo(k, n) and wilson_hi(k, n) as SQL functions, which the optimiser inlines."""
    for name, sign in (("wilson_lo", "-"), ("wilson_hi", "+")):
        body = f"CASE WHEN n > 0 THEN (k / n + 1.9208D / n {sign} 1.96D * sqrt(k / n * (1 - k / n) / n + 0.9604D / (n * n))) / (1 + 3.8416D / n) END"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(k DOUBLE, n DOUBLE) RETURNS DOUBLE RETURN {body}")
