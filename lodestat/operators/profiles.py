"""Profiles of a dataset: yields, coverage, joint fill, candidates, extremes, completion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestat.functions import scalars as S
from lodestat.operators.ranges import numbered, running
from lodestat.operators.tables import agg_percentiles, with_total


def defect_counts(df: DataFrame, defects: dict[str, Column]) -> DataFrame:
    """defect, n, share of all rows; unknown counts as no defect."""
    counts = df.agg(F.count(F.lit(1)).alias("all"), *(F.count_if(c).alias(name) for name, c in defects.items()))
    return counts.unpivot("all", list(defects), "defect", "n").select("defect", "n", (F.col("n") / F.col("all")).alias("share"))


def joint_fill(df: DataFrame, row: Column, col: str, cells: int) -> DataFrame:
    """Rows of each cell of a dense grid (0 .. cells - 1 by the values of col), and their ratio to a uniform share."""
    counted = df.groupBy(row.alias("cell"), col).agg(F.count(F.lit(1)).alias("n"))
    grid = counted.select(col).distinct().withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    every = Window.partitionBy()
    filled = grid.join(counted, [col, "cell"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return filled.select(col, "cell", "n", (F.col("n") * F.count(F.lit(1)).over(every) / F.sum("n").over(every)).alias("ratio"))


def bin_profile(df: DataFrame, by: Column, accepted: Column, value: str) -> DataFrame:
    """n, accept rate and the accepted rows' median and 95 % quantile of value by bin."""
    rows = df.withColumn("bin", by)
    out = agg_percentiles(rows, ["bin"], F.when(accepted, F.col(value)), [0.5, 0.95], F.count(F.lit(1)).alias("n"), S.share_true(accepted).alias("accept_rate"))
    return out.select("bin", "n", "accept_rate", F.get("q", F.lit(0)).alias("q50"), F.get("q", F.lit(1)).alias("q95"))


def yields(df: DataFrame, delivered: Column, denominators: dict[str, Column]) -> DataFrame:
    """Delivered rows per denominator, each with its Wilson interval."""
    counts = df.agg(*(F.struct(F.count_if(of & delivered).alias("k"), F.count_if(of).alias("n")).alias(name) for name, of in denominators.items()))
    each = counts.unpivot([], list(denominators), "denominator", "v").select("denominator", "v.k", "v.n")
    lo, hi = S.wilson(F.col("k"), F.col("n"))
    return each.select("denominator", "k", "n", F.try_divide("k", "n").alias("rate"), lo.alias("lo"), hi.alias("hi"))


def candidate_profile(df: DataFrame, flags: dict[str, Column], measure: str) -> DataFrame:
    """n and the mean of a measure for each value of each flag."""
    long = df.select(F.col(measure), *(c.alias(name) for name, c in flags.items())).unpivot(measure, list(flags), "flag", "value")
    return long.groupBy("flag", "value").agg(F.count(F.lit(1)).alias("n"), F.avg(measure).alias("mean"))


def continuity_summary(df: DataFrame, by: str, order: list[str], value: str, limit: float) -> DataFrame:
    """Steps between neighbours: measured, unmeasured, pass rate among the measured, largest step and least margin. A group's first step is unmeasured."""
    step = F.abs(F.col(value) - F.lag(value).over(Window.partitionBy(by).orderBy(*order)))
    s = F.col("step")
    return df.select(by, step.alias("step")).groupBy(by).agg(
        F.count("step").alias("measured"), F.count_if(s.isNull()).alias("unmeasured"), F.avg((s <= limit).cast("double")).alias("pass_rate"), F.max("step").alias("max_step"), F.min(limit - s).alias("min_margin")
    )


def coverage(df: DataFrame, value: str, edges: list[float], least: float) -> DataFrame:
    """Share of each bin and whether it reaches the least share; values outside all bins are left out."""
    counted = df.select(S.bin_index(F.col(value), edges).alias("bin")).where("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    bins = df.sparkSession.range(len(edges) - 1).select(F.col("id").cast("int").alias("bin"))
    share = F.try_divide(F.col("n"), F.sum("n").over(Window.partitionBy()))
    full = bins.join(counted, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.select("bin", "n", share.alias("share")).withColumn("covered", F.col("share") >= least)


def dataset_stats(df: DataFrame, value: str, key: str) -> DataFrame:
    """Long table of counts, distinct keys and quantiles."""
    counts = (F.count(F.lit(1)).cast("double").alias("rows"), F.count_distinct(key).cast("double").alias("distinct_keys"), F.min(value).alias("min"), F.max(value).alias("max"))
    stats = agg_percentiles(df, [], value, [0.5, 0.95], *counts)
    stats = stats.select("rows", "distinct_keys", "min", F.get("q", F.lit(0)).alias("median"), F.get("q", F.lit(1)).alias("p95"), "max")
    return stats.unpivot([], stats.columns, "statistic", "value")


def pick_extremes(df: DataFrame, by: str, value: str, key: str) -> DataFrame:
    """The least, the n // 2-th (from 0) and the largest row of each group; ties by key."""
    known = df.where(F.col(value).isNotNull()).select(by, value, key)
    ranked = with_total(numbered(known, [by], [value, key], "r"), known, by, n=F.count(F.lit(1)))
    places = {"min": F.lit(1), "mid": F.floor(F.col("n") / 2) + 1, "max": F.col("n")}
    kinds = F.array_compact(F.array(*(F.when(F.col("r") == place, name) for name, place in places.items())))
    return ranked.select(by, F.explode(kinds).alias("kind"), key, value)


def select_seed(df: DataFrame, by: str, score: str, key: str, gap: Column) -> DataFrame:
    """The best row of each group among those within the gap: highest score, nulls last, then the least key."""
    order = Window.partitionBy(by).orderBy(F.desc_nulls_last(score), key)
    return df.where(gap).withColumn("_r", F.row_number().over(order)).where("_r = 1").select(by, key, score)


QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def profile(df: DataFrame, value: str, lo: float, hi: float) -> DataFrame:
    """valid, missing and outside counts, the 5, 25, 50, 75 and 95 % quantiles and the mean; values outside the domain stay in the quantiles."""
    v = S.present(F.col(value))
    out = agg_percentiles(df, [], v, list(QUANTILES), F.count(v).alias("valid"), F.count_if(v.isNull()).alias("missing"), F.count_if((v < lo) | (v > hi)).alias("outside"), F.avg(v).alias("mean"))
    return out.select("valid", "missing", "outside", *(F.get("q", F.lit(i)).alias(f"q{int(100 * q):02d}") for i, q in enumerate(QUANTILES)), "mean")


def completion_status(df: DataFrame, key: str, usable: Column, n: int, cap: int) -> DataFrame:
    """One row: attempts in order of key until n usable rows are there, delivered rows, and complete, cap_hit or incomplete."""
    done = df.where(usable).select(key).orderBy(key).limit(n).agg(F.count(F.lit(1)).alias("delivered"), F.max(key).alias("last"))
    delivered, last = done.select("delivered").scalar(), done.select("last").scalar()
    out = df.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col(key) <= last).alias("upto")).withColumn("delivered", delivered)
    out = out.select(F.when(F.col("delivered") < n, F.col("all")).otherwise(F.col("upto")).alias("attempts"), "delivered")
    return out.withColumn("status", F.when(F.col("attempts") > cap, "cap_hit").when(F.col("delivered") == n, "complete").otherwise("incomplete"))
