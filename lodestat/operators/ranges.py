"""Order over whole tables: places, running totals and ranks in range partitions, so that no group has to be sorted in one task.

Rows are dealt to range partitions by (group, order) and written. A running value is that of the row's part of its group plus that of the
group's earlier parts. Only the parts that a range boundary cuts have earlier ones, so there are fewer of these than partitions, however
large a group is. The order should end with a key; rows that are equal in all of it may come in any order.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestat.storage import materialize

PART, AT = "_part", "_at"
#: How a running value is joined with what came before it.
JOIN: dict[str, tuple[Callable, Callable]] = {
    "sum": (F.sum, lambda a, b: a + b),
    "count": (F.count, lambda a, b: a + b),
    "xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b)),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
}


def same(names: list[str], left: str, right: str) -> Column:
    """Null-safe equality of the named columns of two aliased tables."""
    return reduce(lambda a, b: a & b, (F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in names))


def in_order(df: DataFrame, *order: str | Column) -> DataFrame:
    """df in a written table, with _part and _at: the rows in ascending (_part, _at) are in the order given."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the number in its partition
    return materialize(placed.withColumn(PART, F.spark_partition_id()).withColumn(AT, place), "ordered")


def accumulate(placed: DataFrame, by: list[str], **values: tuple[str, Column]) -> DataFrame:
    """Adds to a table of in_order() whose order begins with by: for each name=(kind, column) the running sum, count, xor, min or max of
    the row's group up to and with the row. A running value is null as long as the group has only null values (0 for sum and count)."""
    w = Window.partitionBy(PART, *by).orderBy(AT).rowsBetween(Window.unboundedPreceding, 0)
    none = {k: (lambda c: F.coalesce(c, F.lit(0))) if kind in ("sum", "count") else (lambda c: c) for k, (kind, _) in values.items()}
    own = placed.withColumns({k: none[k](JOIN[kind][0](c).over(w)) for k, (kind, c) in values.items()})
    parts = placed.groupBy(*by, PART).agg(*(none[k](JOIN[kind][0](c)).alias(k) for k, (kind, c) in values.items()))
    past = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    whole = {"sum": F.sum, "count": F.sum, "xor": F.bit_xor, "min": F.min, "max": F.max}
    carry = parts.select(*by, PART, F.count(F.lit(1)).over(past).alias("_earlier"), *(whole[kind](k).over(past).alias(k) for k, (kind, _) in values.items()))
    carry = F.broadcast(carry.where("_earlier > 0").drop("_earlier"))  # fewer rows than range partitions
    both = own.alias("o").join(carry.alias("c"), same([*by, PART], "o", "c"), "left")

    def total(name: str, kind: str) -> Column:
        mine, before = F.col(f"o.{name}"), F.col(f"c.{name}")
        return F.when(before.isNull(), mine).when(mine.isNull(), before).otherwise(JOIN[kind][1](mine, before))

    return both.select(*(f"o.{c}" for c in placed.columns), *(total(k, kind).alias(k) for k, (kind, _) in values.items()))


def running(df: DataFrame, by: list[str], order: list[str | Column], **values: tuple[str, Column]) -> DataFrame:
    """df with running values of each group in an order; see accumulate."""
    return accumulate(in_order(df, *by, *order), by, **values).drop(PART, AT)


def numbered(df: DataFrame, by: list[str], order: list[str | Column], name: str = "number") -> DataFrame:
    """df with the number of each row in its group, from 1."""
    return running(df, by, order, **{name: ("count", F.lit(1))})
