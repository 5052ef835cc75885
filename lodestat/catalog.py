"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestat.operators import tables
from lodestat.plans import audits, cases, compare, core, evaluation, files, geometry, profiles, registry, shapes, streams  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """All-pass rate with its interval by priority, over the lines of each order."""
    j = spark.read.parquet(f"{d}/lineitem.parquet").join(spark.read.parquet(f"{d}/orders.parquet"), [core.F.col("l_orderkey") == core.F.col("o_orderkey")])
    return tables.rate_by(j, core.S.all_pass(*core.gates().values()), ["o_orderpriority"])
