"""Schedules, allocations, spread-out picks and drawn noise. All draws are hashes of keys, so they do not depend on how a table is split."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestat.functions.scalars import erf
from lodestat.operators.density import hashed_uniform
from lodestat.operators.tables import quota_select


def interleave(df: DataFrame, stratum: str, key: str, cycle: list[str], n: int) -> DataFrame:
    """(slot, stratum, key) of n slots: slot i takes the next row of stratum cycle[i % len(cycle)], rows in the order of the MD5 of their key. Slots whose
    stratum has run out have a null key. Only as many rows of a stratum as it has slots are ranked."""
    size = len(cycle)
    slots = df.sparkSession.range(n).select(F.col("id").alias("slot"), F.get(F.array(*map(F.lit, cycle)), (F.col("id") % size).cast("int")).alias(stratum))
    slots = slots.withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy("slot")))
    most = max(cycle.count(x) for x in cycle) * -(-n // size)
    rows = quota_select(df.select(stratum, key), stratum, key, most)
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy(F.md5(F.col(key).cast("string")), key)))
    return slots.join(ranked, [stratum, "_r"], "left").select("slot", stratum, key)


def allocate_stratum(df: DataFrame, key: str, member: Column, order: list[Column], n: int) -> DataFrame:
    """(swap, incoming, outgoing): the least swaps after which a stratum of n rows holds the n best ones. The best is paired with the worst that leaves."""
    best = df.orderBy(*order, key).limit(n).select(key, *(c.alias(f"_o{i}") for i, c in enumerate(order)), member.alias("_m"))
    rank = [f"_o{i}" for i in range(len(order))]
    new = best.where(~F.col("_m")).withColumn("swap", F.row_number().over(Window.partitionBy().orderBy(*rank, key)))
    own = df.where(member).join(best.select(key), key, "left_anti")
    old = own.orderBy(*(c.desc() for c in order), F.desc(key)).limit(n)
    old = old.withColumn("swap", F.row_number().over(Window.partitionBy().orderBy(*(c.desc() for c in order), F.desc(key))))
    return new.select("swap", F.col(key).alias("incoming")).join(old.select("swap", F.col(key).alias("outgoing")), "swap")


def maximin(df: DataFrame, key: str, features: list[Column], k: int, save: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(pick, key, distance) of k rows that lie far apart: features are standardised, the first pick is farthest from the centre, each next one farthest
    from all picks so far; ties go to the least key. Each round is one pass that keeps a running least distance; save cuts the lineage."""
    names = [f"x{i}" for i in range(len(features))]
    raw = df.select(key, *(c.cast("double").alias(n) for c, n in zip(features, names, strict=True)))
    stats = raw.agg(*(F.avg(n).alias(f"m_{n}") for n in names), *(F.stddev_pop(n).alias(f"s_{n}") for n in names))
    z = raw.join(F.broadcast(stats)).select(key, F.array(*(F.coalesce(F.try_divide(F.col(n) - F.col(f"m_{n}"), F.col(f"s_{n}")), F.lit(0.0)) for n in names)).alias("z"))
    far = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    table = z.withColumn("d", far(F.col("z"), F.array(*(F.lit(0.0) for _ in names))))
    picks = []
    for i in range(k):
        table = save(table) if save else table
        top = table.agg(F.min(F.struct((-F.col("d")).alias("o"), F.col(key).alias("key"), "z")).alias("t")).select("t.*").first()
        if top is None or top.o is None:
            break
        picks.append((i, top.key, float(-top.o)))
        away = far(F.col("z"), F.array(*(F.lit(float(x)) for x in top.z)))
        table = table.withColumn("d", away if i == 0 else F.least("d", away))
    return df.sparkSession.createDataFrame(picks, f"pick int, {key} {df.schema[key].dataType.simpleString()}, distance double")


def lognormal_mass(lo: Column, hi: Column, mu: float, sigma: float, floor: float = 1e-9) -> Column:
    """Mass of a log-normal between lo and hi, at least floor."""
    below = lambda x: F.when(x > 0, 0.5 * (1 + erf((F.log(x) - mu) / (sigma * math.sqrt(2))))).otherwise(0.0)
    return F.greatest(below(hi) - below(lo), F.lit(floor))


def perturb(df: DataFrame, key: str, value: str, sigmas: list[float], trials: int, seed: int = 0) -> DataFrame:
    """(key, sigma, trial, noisy): each value with normal noise (Box-Muller on hashed uniforms), once per sigma and trial."""
    each = df.select(key, value, F.explode(F.array(*(F.lit(float(s)) for s in sigmas))).alias("sigma")).withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    u, v = (hashed_uniform(F.col(key), F.col("trial"), F.lit(seed), F.lit(x)) for x in ("u", "v"))
    z = F.sqrt(-2 * F.log(u + 2.0**-33)) * F.cos(2 * math.pi * v)
    return each.select(key, "sigma", "trial", (F.col(value) + F.col("sigma") * z).alias("noisy"))
