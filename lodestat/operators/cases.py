"""Case logs and file lists: precedence, locks, atlases, budgets, allowed additions, exclusion lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestat.functions import scalars as S


def project_sources(df: DataFrame, sources: dict[str, list[tuple[str, str]]]) -> DataFrame:
    """One column for each output: the first value that is not missing among its (container, field) pairs. Fields absent from the schema are left out."""
    kinds = {(c.name, f.name): f.dataType.simpleString() for c in df.schema for f in getattr(c.dataType, "fields", [])}

    def first(name: str) -> Column:
        found = [S.present(F.col(f"{c}.{f}"), kinds[c, f]) for c, f in sources[name] if (c, f) in kinds]
        return (S.pick(*found) if found else F.lit(None)).alias(name)

    return df.select(*map(first, sources))


def lock_cases(accepted: DataFrame, rejected: DataFrame, plans: DataFrame, key: str) -> DataFrame:
    """key, verdict and whether a plan is there, for accepted and rejected cases; plans has each key once."""
    both = accepted.select(key, F.lit("accepted").alias("verdict")).unionByName(rejected.select(key, F.lit("rejected").alias("verdict")))
    return both.join(plans.select(key, F.lit(True).alias("has_plan")), key, "left").withColumn("has_plan", F.coalesce("has_plan", F.lit(False)))


def failure_atlas(cases: DataFrame, runs: DataFrame, key: str, run: str, names: list[str], score: str, item: str) -> DataFrame:
    """A row for each case: attempts, the best item (highest score, then the largest item) and the best score in each named run."""
    best = F.max(F.struct(score, item))
    wide = runs.groupBy(key).agg(
        F.count(F.lit(1)).alias("attempts"), best[item].alias("best_item"), *(F.max(F.when(F.col(run) == n, F.col(score))).alias(f"run_{i}") for i, n in enumerate(names, 1))
    )
    return cases.select(key).join(wide, key, "left").withColumn("attempts", F.coalesce("attempts", F.lit(0)))


def budget_usage(log: DataFrame, by: str, order: str, item: str, k: int) -> DataFrame:
    """Uses of the first k different items of each group are free, later ones paid; a repeated item is as its first use."""
    first = log.withColumn("_first", F.min(order).over(Window.partitionBy(by, item)))
    rank = F.dense_rank().over(Window.partitionBy(by).orderBy("_first"))
    return first.select(by, rank.alias("r")).groupBy(by).agg(F.count_if(F.col("r") <= k).alias("free"), F.count_if(F.col("r") > k).alias("paid"))


def check_additions(extra: DataFrame, allow: DataFrame, keys: list[str]) -> DataFrame:
    """keys and status: allowed where all keys agree, unexpected for other extras, missing for allowed rows that are not there."""
    a, b = extra.select(*keys).distinct().withColumn("_a", F.lit(1)), allow.select(*keys).distinct().withColumn("_b", F.lit(1))
    status = F.when(F.col("_a").isNull(), "missing").when(F.col("_b").isNull(), "unexpected").otherwise("allowed")
    return a.join(b, keys, "full_outer").select(*keys, status.alias("status"))


def lint_exclusions(entries: DataFrame, inventory: DataFrame, line: str, path: str) -> DataFrame:
    """line and code of each fault of a list: PATH_ESCAPE, ABSOLUTE_PATH, STALE_ENTRY, DUPLICATE_OF_LINE_n. Blank lines have none."""
    p = F.col(path)
    lines = entries.where(F.trim(p) != "").select(line, path)
    known = inventory.select(path).distinct().withColumn("_known", F.lit(True))
    each = lines.join(lines.groupBy(path).agg(F.min(line).alias("_first")), path).join(known, path, "left")
    codes = [
        F.when(p.rlike(r"(^|/)\.\.(/|$)"), "PATH_ESCAPE"), F.when(p.rlike("^(/|[A-Za-z]:)"), "ABSOLUTE_PATH"), F.when(F.col("_known").isNull(), "STALE_ENTRY"),
        F.when(F.col(line) > F.col("_first"), F.concat(F.lit("DUPLICATE_OF_LINE_"), F.col("_first").cast("string"))),
    ]
    return each.select(line, F.explode(F.array_compact(F.array(*codes))).alias("code"))
