"""Operators on whole tables: joins, aggregates, windows, picks, comparison, duplicates. All take and return DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestat.functions.scalars import count_true, group_label, share_true, wilson
from lodestat.operators.density import hashed_uniform
from lodestat.operators.ranges import numbered, running, same
from lodestat.storage import materialize


# percentiles


def percentiles(df: DataFrame, by: list[str], value: str | Column, ps: list[float], accuracy: int = 10000) -> DataFrame:
    """by and q: the exact linear percentiles of the non-null values of each group.

    A sketch gives bounds around each percentile. Values outside them are only counted, so that a group's window sorts no more than the
    distinct values within the bounds, about 20 / accuracy of the group.
    """
    v = df.select(*by, (F.col(value) if isinstance(value, str) else value).cast("double").alias("_v")).where("_v is not null")
    margin = 10 / accuracy
    ends = [min(1.0, max(0.0, p + d)) for p in ps for d in (-margin, margin)]
    sketch = v.groupBy(*by).agg(F.percentile_approx("_v", ends, accuracy).alias("_e"))
    if by:
        sketch = sketch.select(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), "_e")
        both = v.join(sketch, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by))))
    else:
        both = v.join(F.broadcast(sketch))  # one row
    bound = lambda k: F.get("_e", F.lit(k))
    zones = F.array(*(F.when(F.col("_v") < bound(2 * i), -1).when(F.col("_v") > bound(2 * i + 1), 1).otherwise(0) for i in range(len(ps))))
    # rows are counted by where they lie to all bounds, and only what is left of them is looked at for each percentile
    block = both.select(*by, "_v", zones.alias("_zs")).withColumn("_w", F.when(F.array_contains("_zs", 0), F.col("_v")))
    block = block.groupBy(*by, "_zs", "_w").agg(F.count(F.lit(1)).alias("_n"), F.max("_v").alias("_top"), F.min("_v").alias("_bottom"))
    each = block.select(*by, F.posexplode("_zs").alias("_i", "_z"), "_w", "_n", "_top", "_bottom").withColumn("_p", F.get(F.array(*(F.lit(float(p)) for p in ps)), F.col("_i")))
    block = each.groupBy(*by, "_i", "_p", "_z", F.when(F.col("_z") == 0, F.col("_w")).alias("_w")).agg(F.sum("_n").alias("_n"), F.max("_top").alias("_top"), F.min("_bottom").alias("_bottom"))
    w = Window.partitionBy(*by, "_i")
    run = w.orderBy("_z", "_w").rowsBetween(Window.unboundedPreceding, 0)
    block = block.withColumn("_last", F.sum("_n").over(run)).withColumn("_at", F.col("_p") * (F.sum("_n").over(w) - 1))
    edge = F.when(F.col("_z") < 0, F.col("_top")).otherwise(F.col("_bottom"))  # a bound is at most one rank away
    holds = lambda k: F.max(F.when((k < F.col("_last")) & (k >= F.col("_last") - F.col("_n")), edge))
    pair = block.groupBy(*by, "_i", "_at").agg(holds(F.floor("_at")).alias("_a"), holds(F.ceil("_at")).alias("_b"))
    q = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_at") - F.floor("_at"))
    out = F.array_sort(F.collect_list(F.struct("_i", q.alias("q"))))  # one for each of ps; none if there are no rows at all
    return pair.groupBy(*by).agg(F.when(F.count(F.lit(1)) > 0, F.transform(out, lambda x: x["q"])).alias("q"))


def agg_percentiles(df: DataFrame, by: list[str], value: str | Column, ps: list[float], *aggs: Column) -> DataFrame:
    """by, aggs and q, an array of percentiles(); null where a group has no value."""
    out, q = df.groupBy(*by).agg(*aggs), percentiles(df, by, value, ps)
    if not by:
        return out.join(F.broadcast(q), F.lit(True), "left")  # one row each
    q = q.select(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), "q")
    return out.join(q, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by))), "left").drop(*(f"_by{i}" for i in range(len(by))))


# joins


def presence_matrix(key: str, **tables: DataFrame) -> DataFrame:
    """One row a key with has_<name> for every table."""
    parts = [t.select(key).distinct().withColumn(f"has_{n}", F.lit(True)) for n, t in tables.items()]
    return reduce(lambda a, b: a.join(b, key, "full_outer"), parts).na.fill(False)


def pair_check(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys as paired, orphan_left or orphan_right."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    say = lambda df, s: df.withColumn("state", F.lit(s))
    return say(a.join(b, key, "left_semi"), "paired").union(say(a.join(b, key, "left_anti"), "orphan_left")).union(say(b.join(a, key, "left_anti"), "orphan_right"))


def guarded_join(rows: DataFrame, manifest: DataFrame, key: str, guard: str) -> DataFrame:
    """Left join that only matches where guard (the declared source) agrees too; rows are never added."""
    one = manifest.dropDuplicates([key, guard])
    return rows.join(one, [key, guard], "left")


def paired_compare(base: DataFrame, new: DataFrame, key: str, value: str, good: str, error: str) -> DataFrame:
    """One row: matched cases, recovered, regressed, medians and nearest-rank 95 % of both values, and the medians of the differences of
    value (run time, say) and error in matched cases, of which error counts only where both are good."""
    side = lambda df, x: df.select(key, F.col(value).alias(f"v{x}"), F.col(good).alias(f"g{x}"), F.col(error).alias(f"e{x}"))
    both = materialize(side(base, "b").join(side(new, "n"), key), "cases")  # read once for each figure
    lost, won = F.col("gb") & ~F.coalesce("gn", F.lit(False)), ~F.coalesce("gb", F.lit(False)) & F.col("gn")
    out = both.agg(F.count(F.lit(1)).alias("n_cases"), count_true(won).alias("recovered"), count_true(lost).alias("regressed"))
    parts = {"median_base": F.col("vb"), "median_new": F.col("vn"), "delta_value": F.col("vn") - F.col("vb"), "delta_error": F.when(F.col("gb") & F.col("gn"), F.col("en") - F.col("eb"))}
    for name, c in parts.items():
        out = out.join(F.broadcast(percentiles(both, [], c, [0.5]).select(F.get("q", F.lit(0)).alias(name))), F.lit(True), "left")  # one row
    for name, c in (("p95_base", "vb"), ("p95_new", "vn")):
        q = quantile_rank(both.withColumn("_all", F.lit(0)), c, [0.95], "_all").select(F.col("q").alias(name))
        out = out.join(F.broadcast(q), F.lit(True), "left")  # one row
    return out


def path_prefixes(path: Column) -> Column:
    """All proper ancestors of a path, and the path."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def prefix_conflicts(moves: DataFrame, owned: DataFrame, path: str, owner_path: str) -> DataFrame:
    """moves whose path equals or lies below an owned path: an equi-join on exploded prefixes, not a startswith loop."""
    return moves.withColumn("_p", F.explode(path_prefixes(F.col(path)))).join(owned.withColumnRenamed(owner_path, "_p"), "_p").withColumnRenamed("_p", owner_path)


# aggregates


def with_total(df: DataFrame, of: DataFrame, by: str, **totals: Column) -> DataFrame:
    """df with totals over each group of another table."""
    t = of.groupBy(by).agg(*(c.alias(k) for k, c in totals.items()))
    return df.alias("a").join(t.alias("b"), same([by], "a", "b")).select("a.*", *(f"b.{k}" for k in totals))


def means_in_order(df: DataFrame, by: str, order: list[str], **values: Column) -> DataFrame:
    """by and the mean of each value, added up one row after the other in the order given: a sum of doubles is the same however the rows are
    split. A group passes one task, which keeps what does not fit in memory on disk."""
    w = Window.partitionBy(by).orderBy(*order)
    sums = {k: F.avg(k).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) for k in values}
    rows = df.select(by, *order, *(c.alias(k) for k, c in values.items()))
    return rows.withColumns(sums | {"_next": F.lead(F.lit(1)).over(w)}).where("_next is null").select(by, *values)


def count_by(df: DataFrame, col: str | Column) -> DataFrame:
    return df.groupBy(group_label(F.col(col) if isinstance(col, str) else col).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def summarize_numeric(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """n, mean, min, linear p50/p90/p95 and max, by group."""
    out = agg_percentiles(df, by, value, [0.5, 0.9, 0.95], F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    return out.select(*by, "n", "mean", "lo", *(F.get("q", F.lit(i)).alias(k) for i, k in enumerate(("p50", "p90", "p95"))), "hi")


def quantile_rank(df: DataFrame, value: str, ps: list[float], by: str) -> DataFrame:
    """Nearest-rank quantiles v[min(n - 1, int(p * n))], from running counts of distinct values."""
    c = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("c"))
    cum = with_total(running(c, [by], [value], hi=("sum", F.col("c"))), c, by, n=F.sum("c")).withColumn("p", F.explode(F.array(*map(F.lit, ps))))
    at = F.least(F.col("n") - 1, F.floor(F.col("p") * F.col("n")))
    return cum.where((at < F.col("hi")) & (at >= F.col("hi") - F.col("c"))).select(by, "p", F.col(value).alias("q"))


def rate_by(df: DataFrame, flag: Column, by: list[str]) -> DataFrame:
    """n, passed, rate and its Wilson interval by group."""
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), count_true(flag).alias("passed"), share_true(flag).alias("rate"))
    lo, hi = wilson(F.col("passed"), F.col("n"))
    return out.withColumns({"rate_lo": lo, "rate_hi": hi})


def summarize_run(df: DataFrame, mode: str, gates: dict[str, Column]) -> DataFrame:
    """Overall and per mode in one pass: n, all_pass and fail count of each gate; the total has is_total true."""
    own = df.select(mode, *(c.alias(k) for k, c in gates.items()))
    ok = reduce(lambda a, b: a & b, (F.col(k) for k in gates))
    return own.rollup(mode).agg(F.grouping(mode).alias("g"), F.count(F.lit(1)).alias("n"), count_true(ok).alias("all_pass"), *(count_true(F.col(k) == F.lit(False)).alias(f"fail_{k}") for k in gates)).withColumn("is_total", F.col("g") == 1).drop("g")


def cross_tab(df: DataFrame, row: str, col: str, values: list[str]) -> DataFrame:
    return df.groupBy(row).pivot(col, values).agg(F.count(F.lit(1))).na.fill(0)


def share_table(df: DataFrame, stage: str, reason: str) -> DataFrame:
    """n of each reason and its share of its stage."""
    n = df.groupBy(stage, reason).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(stage)))


def sum_map(df: DataFrame, json: str) -> DataFrame:
    """Sum by key of a JSON map column."""
    each = df.select(F.explode(F.from_json(json, "map<string,double>")).alias("key", "v"))
    return each.groupBy("key").agg(F.sum("v").alias("total"), F.count("v").alias("n"))


def count_tokens(df: DataFrame, col: str, sep: str) -> DataFrame:
    each = df.select(F.explode(F.split(col, sep)).alias("token")).where("token <> ''")
    return each.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def flag_combos(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """Rows by the set of their true flags, as joined letters or none."""
    name = F.concat(*(F.when(c, k).otherwise("") for k, c in flags.items()))
    return df.groupBy(F.when(name == "", "none").otherwise(name).alias("combo")).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width bins, the last closed; share of all."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))  # one row
    step = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.floor((F.col(value) - F.col("lo")) / step), F.lit(bins - 1)).cast("int")
    n = df.where(F.col(value).isNotNull()).join(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def axis_marginals(df: DataFrame, axes: list[str], prescribed: DataFrame, accepted: Column) -> DataFrame:
    """Prescribed against accepted and attempted shares of every (axis, key), keys that nobody took included."""
    long = df.withColumn("_a", F.coalesce(accepted, F.lit(False))).select("_a", F.explode(F.create_map(*(x for a in axes for x in (F.lit(a), F.col(a).cast("string"))))).alias("axis", "key"))
    n = long.groupBy("axis", "key").agg(F.count(F.lit(1)).alias("tried"), count_true(F.col("_a")).alias("accepted_n"))
    total = n.groupBy("axis").agg(F.sum("tried").alias("all_tried"), F.sum("accepted_n").alias("all_accepted"))
    out = prescribed.join(n, ["axis", "key"], "left").join(total, "axis", "left").na.fill(0, ["tried", "accepted_n"])
    out = out.withColumns({"attempted_frac": F.try_divide("tried", "all_tried"), "accepted_frac": F.try_divide("accepted_n", "all_accepted")})
    out = out.withColumn("abs_error", F.abs(F.col("accepted_frac") - F.col("prescribed"))).withColumn("starved", (F.col("prescribed") > 0) & (F.col("accepted_n") == 0))
    return out.drop("tried", "all_tried", "all_accepted")


def cost_by(df: DataFrame, by: str, cost: str) -> DataFrame:
    """n, total, mean, linear median/p90/p95, max of the non-zero costs."""
    on = F.when(F.col(cost) != 0, F.col(cost))
    out = agg_percentiles(df, [by], on, [0.5, 0.9, 0.95], F.count(F.lit(1)).alias("n"), F.sum(cost).alias("total"), F.avg(cost).alias("mean"), F.max(cost).alias("hi"))
    return out.select(by, "n", "total", "mean", *(F.get("q", F.lit(i)).alias(k) for i, k in enumerate(("median", "p90", "p95"))), "hi")


def cost_share(df: DataFrame, sig: str, cost: str) -> DataFrame:
    """Cost of each signature, its share, rank and cumulative share; signatures are a bounded set of labels."""
    t = df.groupBy(sig).agg(F.sum(cost).alias("total"))
    w = Window.partitionBy()
    order = w.orderBy(F.desc("total"), sig)
    t = t.withColumn("share", F.col("total") / F.sum("total").over(w)).withColumn("rank", F.row_number().over(order))
    return t.withColumn("cum_share", F.sum("share").over(order))


def threshold_sweep(df: DataFrame, value: str, thresholds: list[float], measure: Column) -> DataFrame:
    """n, share and mean measure of rows at or above every threshold, in one pass over the rows."""
    aggs = [F.struct(F.lit(float(t)).alias("threshold"), count_true(F.col(value) >= t).alias("n"), (count_true(F.col(value) >= t) / F.count(F.lit(1))).alias("share"), F.avg(F.when(F.col(value) >= t, measure)).alias("mean")) for t in thresholds]
    return df.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("x")).select("x.*")


def knee(sweep: DataFrame) -> DataFrame:
    """The threshold before the largest step of the mean, if that is twice the median step and positive. A sweep is a short table."""
    w = Window.partitionBy().orderBy("threshold")
    d = sweep.withColumn("step", F.abs(F.col("mean") - F.lag("mean").over(w))).where("step is not null")
    best = d.agg(F.max_by("threshold", "step").alias("at"), F.max("step").alias("largest"), F.percentile("step", F.lit(0.5)).alias("median"))
    return best.withColumn("is_knee", (F.col("largest") > 0) & (F.col("largest") >= 2 * F.col("median")))


def sequence_gaps(df: DataFrame, key: str, buckets: int = 1 << 16) -> DataFrame:
    """(after, before, missing) of gaps in an integer key. Ranges of keys are windows of their own; their ends meet in a second, short step."""
    k = df.select(F.col(key).alias("k")).where("k is not null").distinct().withColumn("b", F.floor(F.col("k") / buckets))
    w = Window.partitionBy("b").orderBy("k")
    inner = k.withColumn("next", F.lead("k").over(w))
    ends = k.groupBy("b").agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
    outer = ends.select(F.col("hi").alias("k"), F.lead("lo").over(Window.partitionBy().orderBy("b")).alias("next"))
    both = inner.where("next is not null").select("k", "next").union(outer.where("next is not null"))
    return both.where("next - k > 1").select(F.col("k").alias("after"), F.col("next").alias("before"), (F.col("next") - F.col("k") - 1).alias("missing"))


def bias_by(df: DataFrame, target: str, actual: str, by: str) -> DataFrame:
    d = F.col(actual) - F.col(target)
    return df.groupBy(by).agg(F.count(d).alias("n"), F.avg(target).alias("mean_target"), F.avg(actual).alias("mean_actual"), F.avg(d).alias("bias"), F.stddev_pop(d).alias("bias_std"), F.max(F.abs(d)).alias("max_abs"))


def block_check(df: DataFrame, by: str, order: str, size: int, kind: str, want: dict[str, int]) -> DataFrame:
    """Complete blocks of `size` rows in order, by group, and whether each has the wanted number of each kind."""
    b = numbered(df, [by], [order], "_i").withColumn("block", F.floor((F.col("_i") - 1) / size))
    n = b.groupBy(by, "block").agg(F.count(F.lit(1)).alias("n"), *(count_true(F.col(kind) == k).alias(f"_{i}") for i, k in enumerate(want)))
    ok = reduce(lambda x, y: x & y, (F.col(f"_{i}") == v for i, v in enumerate(want.values())))
    return n.where(F.col("n") == size).select(by, "block", ok.alias("ok"))


# windows and picks


def latest_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; a partial aggregate on (order, row), so hot keys combine before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def ecdf(df: DataFrame, value: str, by: str) -> DataFrame:
    """Distinct values with n and the share of rows at or below."""
    c = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    upto = with_total(running(c, [by], [value], _s=("sum", F.col("n"))), c, by, _n=F.sum("n"))
    return upto.select(by, value, "n", (F.col("_s") / F.col("_n")).alias("y"))


def avg_rank(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Distinct values of each group with their average rank, from running counts over range partitions."""
    by = by or []
    c = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return running(c, by, [value], _s=("sum", F.col("n"))).select(*by, value, "n", (F.col("_s") - (F.col("n") - 1) / 2).alias("rank"))


def step_verdict(df: DataFrame, by: str, order: list[str], value: str, tol: float) -> DataFrame:
    """Largest step between neighbours of a group, and whether it is within tol; pairs with null are skipped."""
    d = df.withColumn("_d", F.abs(F.col(value) - F.lag(value).over(Window.partitionBy(by).orderBy(*order))))
    return d.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.max("_d").alias("max_step")).withColumn("ok", F.coalesce(F.col("max_step") <= tol, F.lit(False)))


def flag_duplicates(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("is_repeat", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > 1)


def renumber(df: DataFrame, batch: str, order: str) -> DataFrame:
    """Contiguous numbers from 0 over (batch, order)."""
    return numbered(df, [], [batch, order]).withColumn("number", F.col("number") - 1)


def first_nonzero(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """First row of each group whose value is above 0."""
    return df.where(F.col(value) > 0).groupBy(by).agg(F.min(order).alias("first_at"), F.min_by(value, order).alias("first_value"))


def budget_prefix(df: DataFrame, by: str, order: str, cost: str, limit: float) -> DataFrame:
    """Rows with the running cost of their group and whether it is within the limit."""
    return running(df, [by], [order], running=("sum", F.col(cost))).withColumn("within", F.col("running") <= limit)


def quantile_pick(df: DataFrame, by: str, value: str, key: str, q: float) -> DataFrame:
    """The row at round(q * (n - 1)) of each group, half to even, in the order (value, key)."""
    n = with_total(numbered(df, [by], [value, key], "_i"), df, by, _n=F.count(F.lit(1)))
    return n.where(F.col("_i") - 1 == F.bround(q * (F.col("_n") - 1), 0)).drop("_i", "_n")


def top_k(df: DataFrame, by: str, k: int) -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), by).limit(k)


def rule_subset(df: DataFrame, key: str, rules: dict[str, Column], cap: int) -> DataFrame:
    """Union of rule picks with their reasons; over the cap the rows with most reasons stay, then the least keys."""
    reasons = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))
    out = df.withColumn("reasons", reasons).where(F.size("reasons") > 0).orderBy(F.desc(F.size("reasons")), key).limit(cap)
    return out.withColumn("reasons", F.array_join("reasons", "|"))


def pareto(df: DataFrame, by: str, less: str, more: str) -> DataFrame:
    """Rows of each group that no other beats (less is better in one column, more in the other). A running maximum over the sorted group
    finds them without comparing pairs. Rows with a null axis cannot be compared and stay; for more axes see skyline."""
    d = df.where(F.col(less).isNotNull() & F.col(more).isNotNull())
    v = d.groupBy(by, less).agg(F.max(more).alias("_m"))
    before = F.max("_m").over(Window.partitionBy(by).orderBy(less).rowsBetween(Window.unboundedPreceding, -1))
    front = v.withColumn("_b", before).where("_b is null or _m > _b").select(by, less, F.col("_m").alias(more))
    return d.join(front, [by, less, more], "left_semi").unionByName(df.where(F.col(less).isNull() | F.col(more).isNull()))


def champions(df: DataFrame, by: str, score: str, key: str) -> DataFrame:
    best = df.groupBy(by).agg(F.max_by(F.struct(key, score), F.struct(F.col(score), -F.col(key))).alias("b"))
    return best.select(by, "b.*")


# comparison, duplicates, ledgers


def dataset_diff(a: DataFrame, b: DataFrame, key: str, volatile: list[str]) -> DataFrame:
    """key and state: left_only, right_only, equal, or differs; volatile columns are ignored. If a side has a column that the other lacks, no
    row of both is equal. For paths and nested columns see record_diff."""
    cols = sorted(set(a.columns) & set(b.columns) - {key, *volatile})
    alike = F.lit(set(a.columns) - {*volatile} == set(b.columns) - {*volatile})
    row = lambda df, n: df.select(key, F.struct(*cols).alias(n))
    both = row(a, "x").join(row(b, "y"), key, "full_outer")
    return both.select(key, F.when(F.col("y").isNull(), "left_only").when(F.col("x").isNull(), "right_only").when(alike & F.col("x").eqNullSafe(F.col("y")), "equal").otherwise("differs").alias("state"))


def first_difference(a: DataFrame, b: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """key and the first column, in the order given, in which both sides differ."""
    y = b.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_{c}") for c in cols))
    diff = F.array_compact(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(f"$.{c}")) for c in cols)))
    return a.join(y, F.col(key) == F.col("_k")).select(key, F.get(diff, F.lit(0)).alias("path")).where("path is not null")


def field_mismatches(a: DataFrame, b: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Rows that differ, by column."""
    y = b.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_{c}") for c in cols))
    n = a.join(y, F.col(key) == F.col("_k")).agg(*(count_true(~F.col(c).eqNullSafe(F.col(f"_{c}"))).alias(c) for c in cols))
    return n.unpivot([], cols, "field", "n")


def hash_duplicates(df: DataFrame, content: str, key: str) -> DataFrame:
    """Groups of rows with equal content: hash, size and least key."""
    return df.groupBy(F.sha2(content, 256).alias("hash")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first")).where("n > 1")


def classify_duplicates(df: DataFrame, content: str, signature: list[str]) -> DataFrame:
    """Duplicate groups as identical (all signature columns agree), stale (some differ) or unverifiable (one is always null)."""
    g = df.groupBy(F.sha2(content, 256).alias("hash")).agg(F.count(F.lit(1)).alias("n"), *(F.count_distinct(c).alias(f"d_{c}") for c in signature)).where("n > 1")
    least, most = (f(*(F.col(f"d_{c}") for c in signature)) for f in (F.least, F.greatest))
    return g.select("hash", "n", F.when(least == 0, "unverifiable").when(most > 1, "stale").otherwise("identical").alias("verdict"))


def verify_ledger(claimed: DataFrame, actual: DataFrame, key: str, source_left: DataFrame | None = None) -> DataFrame:
    """Claimed files and bytes (n, total) against actual ones; issues joined by |, or OK. Where both sides have digest (any hash of the
    files' hashes) or license (whether a licence file is there), SHA256 and LICENSE_FILE_LOST are checked; SOURCE_STILL_EXISTS for keys of
    source_left."""
    more = [c for c in ("digest", "license") if c in claimed.columns and c in actual.columns]
    side = lambda df, x: df.select(key, F.col("n").alias(f"n{x}"), F.col("total").alias(f"t{x}"), *(F.col(c).alias(f"{c}{x}") for c in more))
    j = side(claimed, 1).join(side(actual, 2), key, "full_outer")
    issues = [F.when(F.col("n2").isNull(), "MISSING"), F.when(F.col("n1").isNull(), "EXTRA"), F.when(F.col("n1") != F.col("n2"), "FILE_COUNT"), F.when(F.abs(F.col("t1") - F.col("t2")) > 0.005, "TOTAL_BYTES")]
    if "digest" in more:
        issues.append(F.when(F.col("n1").isNotNull() & F.col("n2").isNotNull() & ~F.col("digest1").eqNullSafe(F.col("digest2")), "SHA256"))
    if "license" in more:
        issues.append(F.when(F.col("license1") & F.col("n2").isNotNull() & ~F.coalesce("license2", F.lit(False)), "LICENSE_FILE_LOST"))
    if source_left is not None:
        j = j.join(source_left.select(key).distinct().withColumn("_left", F.lit(True)), key, "left")
        issues.append(F.when(F.col("n1").isNotNull() & F.col("_left"), "SOURCE_STILL_EXISTS"))
    issue = F.concat_ws("|", *issues)
    return j.select(key, F.when(issue == "", "OK").otherwise(issue).alias("issue"))


# sampling


def apportion(df: DataFrame, stratum: str, n: int) -> DataFrame:
    """Largest-remainder shares of n by the strata's sizes; ties by name. Strata are few."""
    w = Window.partitionBy()
    s = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("c")).withColumn("x", F.col("c") * n / F.sum("c").over(w)).withColumn("b", F.floor("x"))
    rest = F.lit(n) - F.sum("b").over(w)
    s = s.withColumn("rest", rest).withColumn("r", F.row_number().over(w.orderBy(F.desc(F.round(F.col("x") - F.col("b"), 9)), stratum)))
    return s.select(stratum, (F.col("b") + (F.col("r") <= F.col("rest")).cast("bigint")).alias("quota"))


def quota_select(df: DataFrame, cell: str, key: str, quota: int, salt: str = "") -> DataFrame:
    """Up to quota rows a cell, in the order of the MD5 of the key: the same rows however the table is partitioned."""
    h = F.md5(F.concat(F.lit(salt), F.col(key).cast("string")))
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(cell).orderBy(h, key))).where(F.col("_r") <= quota).drop("_r")


def weighted_sample(df: DataFrame, by: str, key: str, weight: Column, n: int, seed: int) -> DataFrame:
    """n rows a group without replacement, with chances by weight (exponential keys)."""
    e = -F.log(hashed_uniform(F.col(key), F.lit(seed)) + 2.0**-33) / weight
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(e, key))).where(F.col("_r") <= n).drop("_r")


# statistics


def spearman(df: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """by and spearman: the correlation of the average ranks of rows with both values; null for a group in which a side does not vary."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    rank = F.col("_s") - (F.col("_n") - 1) / 2
    ranked = lambda weights, c: running(weights, [by], [c], _s=("sum", F.col("_n")))
    a = ranked(d.groupBy(by, x).agg(F.count(F.lit(1)).alias("_n")), x).select(by, x, "_n", rank.alias("_p"))
    # a value of y takes the ranks of x along, summed, so that the ranks of y need not be joined with rows again
    b = d.alias("d").join(a.alias("a"), same([by, x], "d", "a")).groupBy(F.col(f"d.{by}").alias(by), F.col(f"d.{y}").alias(y)).agg(F.count(F.lit(1)).alias("_n"), F.sum("_p").alias("_t"))
    b = ranked(b, y).select(by, "_n", "_t", rank.alias("_q"))
    p, q, n = F.col("_p"), F.col("_q"), F.col("_n")
    ofx = a.groupBy(by).agg(F.count(F.lit(1)).alias("_kx"), F.sum(n).alias("_m"), F.sum(n * p).alias("_p"), F.sum(n * p * p).alias("_pp"))
    ofy = b.groupBy(by).agg(F.count(F.lit(1)).alias("_ky"), F.sum(n * q).alias("_q"), F.sum(n * q * q).alias("_qq"), F.sum(F.col("_t") * q).alias("_pq"))
    cov, vp, vq = (F.col(f"_{u}{v}") - F.col(f"_{u}") * F.col(f"_{v}") / F.col("_m") for u, v in ("pq", "pp", "qq"))
    j = ofx.alias("x").join(ofy.alias("y"), same([by], "x", "y"))
    return j.select(F.col(f"x.{by}").alias(by), F.when((F.col("_kx") > 1) & (F.col("_ky") > 1), cov / F.sqrt(vp * vq)).alias("spearman"))


def agreement(df: DataFrame, t: str, a: str, by: str) -> DataFrame:
    """n, mae, quantiles of the absolute error, both correlations and the bias of a against t by group. df is computed once and written."""
    df = materialize(df.select(by, t, a), "pairs")
    d = F.col(a) - F.col(t)
    out = agg_percentiles(df, [by], F.abs(d), [0.5, 0.9, 0.95], F.count(d).alias("n"), F.avg(F.abs(d)).alias("mae"), F.corr(t, a).alias("pearson"), F.avg(d).alias("bias"))
    out = out.alias("o").join(spearman(df, t, a, by).alias("s"), same([by], "o", "s"), "left").select("o.*", "s.spearman")
    return out.select(by, "n", "mae", *(F.get("q", F.lit(i)).alias(k) for i, k in enumerate(("median_ae", "q90", "q95"))), "pearson", "spearman", "bias")


def zero_inflated(df: DataFrame, value: str) -> DataFrame:
    pos = F.when(F.col(value) > 0, F.col(value))
    out = agg_percentiles(df, [], pos, [0.5], count_true(F.col(value) == 0).alias("n_zero"), F.count(pos).alias("n_positive"), (count_true(F.col(value) == 0) / F.count(value)).alias("p_zero"), F.avg(pos).alias("positive_mean"), count_true(F.col(value).isNull()).alias("n_missing"))
    return out.select("n_zero", "n_positive", "p_zero", "positive_mean", F.get("q", F.lit(0)).alias("positive_median"), "n_missing")


def silverman(df: DataFrame, value: str) -> DataFrame:
    """0.9 * min(sd, IQR / 1.349) * n ** -0.2, at least 2 % of the span."""
    s = agg_percentiles(df, [], value, [0.25, 0.75], F.count(value).alias("n"), F.stddev_samp(value).alias("sd"), (F.max(value) - F.min(value)).alias("span"))
    h = 0.9 * F.least(F.col("sd"), (F.get("q", F.lit(1)) - F.get("q", F.lit(0))) / 1.349) * F.pow("n", F.lit(-0.2))
    return s.select("n", F.greatest(h, 0.02 * F.col("span")).alias("bandwidth"))


def kde(df: DataFrame, value: str, lo: float, hi: float, points: int, h: float) -> DataFrame:
    """Gaussian density on a grid with reflection at both ends. Equal values are collapsed first; the grid, of fixed size, is exploded per value."""
    c = df.where(F.col(value).between(lo, hi)).groupBy(value).agg(F.count(F.lit(1)).alias("m"))
    grid = F.explode(F.array(*(F.lit(lo + (hi - lo) * i / (points - 1)) for i in range(points))))
    e = c.select(F.col(value).cast("double").alias("x"), "m", grid.alias("grid"))
    k = lambda x: F.exp(-0.5 * F.pow((F.col("grid") - x) / h, 2))
    total = c.agg(F.sum("m").alias("n"))
    s = e.groupBy("grid").agg(F.sum(F.col("m") * (k(F.col("x")) + k(2 * lo - F.col("x")) + k(2 * hi - F.col("x")))).alias("s"))
    return s.join(F.broadcast(total)).select("grid", (F.col("s") / (F.col("n") * h * (2 * 3.141592653589793) ** 0.5)).alias("density"))


def discrete_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    long = df.select(F.explode(F.create_map(*(x for c in cols for x in (F.lit(c), F.col(c).cast("string"))))).alias("variable", "value"))
    n = long.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy("variable"))).withColumn("is_missing", F.col("value").isNull())
