"""Candidates that no other beats on several axes, and the few of them that are tried next."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.storage import materialize

#: Distinct vectors that one call compares with as many others.
BLOCK = 20_000


def _beaten(victims: np.ndarray, judges: np.ndarray) -> np.ndarray:
    """Whether some other judge is at least as good on every axis; all vectors are distinct."""
    out = np.zeros(len(victims), bool)
    for at in range(0, len(judges), 256):
        j = judges[at : at + 256]
        good, better = np.ones((len(victims), len(j)), bool), np.zeros((len(victims), len(j)), bool)
        for k in range(victims.shape[1]):
            good &= j[:, k] >= victims[:, k, None]
            better |= j[:, k] > victims[:, k, None]
        out |= (good & better).any(1)
    return out


def local_skyline(v: np.ndarray) -> np.ndarray:
    """Indices of the vectors that no other beats. In descending order of sums a vector can be beaten only by an earlier one."""
    order = np.lexsort((*(-v[:, i] for i in reversed(range(v.shape[1]))), -v.sum(1)))
    kept = np.empty(0, int)
    for at in range(0, len(order), 256):
        block = order[at : at + 256]
        block = block[~_beaten(v[block], v[kept])]
        kept = np.append(kept, block[~_beaten(v[block], v[block])])
    return kept


def skyline(df: DataFrame, by: list[str], flags: list[str], margins: list[str], hard: Column, block: int = BLOCK) -> DataFrame:
    """Rows of each group that pass `hard` and that no other passing row dominates.

    A row dominates another if it is at least as good on every axis and better on one. A flag is better if true; a margin counts up to 0,
    for beyond it the gate is passed. A row with a null axis cannot be compared, so it stays and dominates nothing. Rows with equal axes
    stay together.

    Distinct vectors are found first. Groups are packed by their hash, about `block` vectors a pack, and a task finds the skylines of all groups
    of its packs. A pack with more than four times as many, for which one group is enough, is cut into buckets that keep their own skylines;
    what is left of it is cut into blocks, and every block is judged by every other in a task of its own, which returns the beaten vectors.
    """
    axes = [f"_a{i}" for i in range(len(flags) + len(margins))]
    values = [F.col(c).cast("double") for c in flags] + [F.least(F.col(c).cast("double"), F.lit(0.0)) for c in margins]
    value = [F.when(x.isNotNull(), v + F.lit(0.0)) for x, v in zip([F.col(c) for c in (*flags, *margins)], values, strict=True)]  # -0.0 becomes 0.0
    whole = reduce(lambda a, b: a & b, (F.col(a).isNotNull() for a in axes))
    groups = [f"_g{i}" for i in range(len(by))]
    named = {g: F.struct(F.col(c).alias("v")) for c, g in zip(by, groups, strict=True)}
    rows = materialize(df.where(F.coalesce(hard, F.lit(False))).withColumns(dict(zip(axes, value, strict=True)) | named), "candidates")
    vectors = materialize(rows.where(whole).select(*groups, *axes).distinct(), "vectors")
    packs = max(1, -(-vectors.count() // block))
    vectors = vectors.withColumn("_p", F.pmod(F.xxhash64(F.lit(1), *groups), F.lit(packs)))
    sizes = vectors.groupBy("_p").agg(F.ceil(F.count(F.lit(1)) / (4 * block)).cast("int").alias("_n"))  # a row a pack
    kinds = ", ".join(f"{n} {t}" for n, t in vectors.dtypes) + ", _n int"
    numbers = lambda t: np.stack([t[a].to_numpy() for a in axes], 1)

    def each_group(t: pa.Table) -> list[np.ndarray]:
        code = np.zeros(len(t), np.int64)
        for g in groups:
            own = pc.struct_field(t[g].combine_chunks(), "v").dictionary_encode("encode").indices.to_numpy()
            code = np.unique(code * (own.max(initial=0) + 1) + own, return_inverse=True)[1]
        order = np.argsort(code, kind="stable")
        return np.split(order, np.flatnonzero(np.diff(code[order])) + 1)

    def own(t: pa.Table) -> pa.Table:
        v = numbers(t)
        kept = [rows[local_skyline(v[rows])] for rows in each_group(t)]
        return t.take(pa.array(np.concatenate(kept)))

    bucket = F.pmod(F.xxhash64(*axes), F.col("_n"))
    left = vectors.join(F.broadcast(sizes), "_p").select(*groups, *axes, "_p", "_n").withColumn("_b", bucket)
    left = left.groupBy("_p", "_b").applyInArrow(lambda t: own(t.drop(["_b"])), kinds)
    left = materialize(left, "local")
    large = left.where("_n > 1")
    n = large.groupBy("_p").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_m"))
    large = large.join(F.broadcast(n), "_p").withColumn("_i", F.pmod(F.xxhash64(F.lit(1), *axes), F.col("_m")).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("_m") - 1))
    sides = large.withColumn("_j", each).withColumn("_judge", F.lit(False)).unionByName(large.withColumnRenamed("_i", "_j").withColumn("_i", each).withColumn("_judge", F.lit(True)))

    def judge(t: pa.Table) -> pa.Table:
        judges, v, beaten = t["_judge"].to_numpy(), numbers(t), []
        for rows in each_group(t):
            at = rows[~judges[rows]]
            beaten.append(at[_beaten(v[at], v[rows[judges[rows]]])])
        return t.take(pa.array(np.concatenate(beaten))).select([*groups, *axes, "_p", "_n"])

    beaten = sides.groupBy("_p", "_i", "_j").applyInArrow(judge, kinds).select(*groups, *axes).distinct()
    best = large.select(*groups, *axes).join(beaten, [*groups, *axes], "left_anti").unionByName(left.where("_n = 1").select(*groups, *axes))
    kept = rows.where(whole).join(best, [*groups, *axes], "left_semi").unionByName(rows.where(~whole))
    return kept.select(*df.columns)


def beam(df: DataFrame, by: list[str], geometry: str, order: str, score: str, violated: str, margins: list[str], asset: str, categories: list[str], most: int = 3) -> DataFrame:
    """At most `most` rows a group with their role: the best of all, and for each category the best row that violates it alone, or else one
    that violates it among others. A geometry appears once, under its first role.

    Best is: fewest violations, largest least margin (counted up to 0), highest score, first in order, least asset. For the best of all, rows
    with a score go before those without. violated is an array of names, null if unknown; df is a skyline, first rows of each geometry.
    """
    worst = F.array_min(F.array_compact(F.array(*(F.least(F.col(m).cast("double"), F.lit(0.0)) for m in margins))))
    tie = F.struct(
        F.coalesce(F.size(F.col(violated)), F.lit(1 << 20)).alias("n"), (-F.coalesce(worst, F.lit(-99.0))).alias("binding"), (-F.coalesce(F.col(score).cast("double"), F.lit(-99.0))).alias("score"),
        F.coalesce(F.col(order).cast("bigint"), F.lit(1 << 30)).alias("order"), F.coalesce(F.col(asset).cast("string"), F.lit("")).alias("asset"),
    )
    rest = [c for c in df.columns if c not in by]
    row = F.struct(*rest)
    pick = lambda when: F.min_by(row, F.when(when, tie))
    picks = [F.min_by(row, F.struct(F.col(score).isNull().alias("unscored"), tie.alias("t"))).alias("_p0")]
    for i, name in enumerate(categories, 1):
        has = F.coalesce(F.array_contains(violated, F.lit(name)), F.lit(False))
        picks.append(F.coalesce(pick(has & (F.size(violated) == 1)), pick(has)).alias(f"_p{i}"))
    roles = ["global_best", *(f"{c}_champion" for c in categories)]
    best = df.groupBy(*by).agg(*picks)
    entries = F.filter(F.array(*(F.struct(F.lit(r).alias("role"), F.col(f"_p{i}").alias("row")) for i, r in enumerate(roles))), lambda x: x["row"].isNotNull())
    best = best.withColumn("_all", entries)
    seen = lambda i: F.transform(F.slice("_all", F.lit(1), i), lambda y: y["row"][geometry])
    first = F.filter("_all", lambda x, i: ~F.coalesce(F.array_contains(seen(i), x["row"][geometry]), F.lit(False)))
    return best.select(*by, F.posexplode(F.slice(first, 1, most)).alias("place", "_x")).select(*by, "place", "_x.role", "_x.row.*")
