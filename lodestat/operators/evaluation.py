"""Evaluation of runs: trials, sweeps, early stops, keypoint and pose accuracy, convergence, integrity, digests, packages and successor chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestat.functions.geometry import distance
from lodestat.functions.scalars import count_true
from lodestat.operators.tables import agg_percentiles


def rule_audit(df: DataFrame, rules: dict[str, tuple[Column, Column, float]]) -> DataFrame:
    """(rule, n, bad): rows whose stored value lies further than the tolerance from its formula, or where only one of both is null."""
    bad = {k: F.coalesce(F.abs(stored - formula) > tol, stored.isNull() != formula.isNull()) for k, (stored, formula, tol) in rules.items()}
    n = df.agg(F.count(F.lit(1)).alias("n"), *(count_true(c).alias(k) for k, c in bad.items()))
    return n.unpivot(["n"], list(rules), "rule", "bad")


def conditioned_share(df: DataFrame, feasible: list[Column], own: Column, prescribed: list[float]) -> DataFrame:
    """(bin, prescribed, conditioned, realised): the prescribed mass of each row is dealt out over the bins that are feasible for it, then averaged.
    Rows without a feasible bin are left out. Rows are counted by what is feasible for them first, so that few numbers are weighed, in one order."""
    flags = F.array(*(F.coalesce(c, F.lit(False)) for c in feasible))
    n = df.groupBy(flags.alias("f"), own.alias("own")).agg(F.count(F.lit(1)).alias("n"))
    mass = F.zip_with("f", F.array(*(F.lit(float(x)) for x in prescribed)), lambda ok, m: F.when(ok, m).otherwise(0.0))
    n = n.withColumn("m", mass).withColumn("s", F.aggregate("m", F.lit(0.0), lambda a, x: a + x)).where("s > 0")
    patterns = F.array_sort(F.collect_list(F.struct("f", "own", "n", "m", "s")))  # at most one for each set of bins and bin
    all_n = F.aggregate("p", F.lit(0.0), lambda a, x: a + x["n"])

    def share(i: int, f: float) -> Column:
        given = F.aggregate("p", F.lit(0.0), lambda a, x: a + x["n"] * F.get(x["m"], F.lit(i)) / x["s"])
        real = F.aggregate("p", F.lit(0.0), lambda a, x: a + F.when(x["own"] == i, x["n"]).otherwise(0))
        return F.struct(F.lit(i).alias("bin"), F.lit(float(f)).alias("prescribed"), (given / all_n).alias("conditioned"), (real / all_n).alias("realised"))

    shares = [share(i, f) for i, f in enumerate(prescribed)]
    return n.agg(patterns.alias("p")).where(F.size("p") > 0).select(F.explode(F.array(*shares)).alias("x")).select("x.*")


def trial_rollup(trials: DataFrame, by: list[str], solved: Column, shift: Column, turn: Column) -> DataFrame:
    """n, solve_fail, diverged (over 1 m or 45 degrees), pose_fail (not under 5 cm and 5 degrees) and quantiles of the shift; an unsolved trial fails
    all three. A group holds the trials of one frame and noise level, so it is small."""
    ok = F.coalesce(solved, F.lit(False))
    t, r = F.when(ok, shift), F.when(ok, turn)
    q = F.percentile(t, F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95)))
    out = trials.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), count_true(~ok).alias("solve_fail"), count_true(~ok | (t > 1) | (r > 45)).alias("diverged"), count_true(~F.coalesce((t < 0.05) & (r < 5), F.lit(False))).alias("pose_fail"), q.alias("q"))
    return out.select(*by, "n", "solve_fail", "diverged", "pose_fail", *(F.get("q", F.lit(i)).alias(k) for i, k in enumerate(("q50", "q90", "q95"))))


def config_sweep(runs: DataFrame, protected: DataFrame, baseline, min_recall: float = 1.0) -> DataFrame:
    """Per config of runs (config, case, accepted, cost): accepted cases, cost, recall of the protected cases, cases recovered and lost against the
    baseline config, whether it is eligible, and whether it is the cheapest eligible one. Configs are few."""
    base = runs.where((F.col("config") == baseline) & F.col("accepted")).select("case", F.lit(True).alias("in_base")).distinct()
    keep = protected.select("case", F.lit(True).alias("in_protected")).distinct()
    j = runs.join(base, "case", "left").join(keep, "case", "left")
    yes, was = F.coalesce("accepted", F.lit(False)), F.col("in_base").isNotNull()
    n = keep.agg(F.count(F.lit(1)).alias("n_protected"))
    g = j.groupBy("config").agg(count_true(yes).alias("n_accepted"), F.sum("cost").alias("cost"), count_true(yes & F.col("in_protected").isNotNull()).alias("kept"), count_true(yes & ~was).alias("recovered"), count_true(~yes & was).alias("lost"))
    g = g.join(F.broadcast(n)).withColumn("recall", F.try_divide("kept", "n_protected")).withColumn("eligible", F.coalesce(F.col("recall") >= min_recall, F.lit(False)))
    order = Window.partitionBy("eligible").orderBy("cost", "config")
    return g.withColumn("winner", F.col("eligible") & (F.row_number().over(order) == 1)).drop("kept", "n_protected")


def early_stop_audit(log: DataFrame, case: str, stage: str, value: Column, accepted: Column) -> DataFrame:
    """Per cutoff stage: cases that a stop would end there (all values up to it are 0), those of them that were accepted later (false negatives), safe
    stops, and evaluations saved. Windows are per case, whose stages are few."""
    w = Window.partitionBy(case)
    upto = w.orderBy(stage).rowsBetween(Window.unboundedPreceding, 0)
    after = F.count(F.lit(1)).over(w) - F.count(F.lit(1)).over(upto)
    each = log.select(case, F.col(stage).alias("cutoff"), F.max(value).over(upto).alias("top"), F.max(accepted).over(w).alias("won"), after.alias("after"))
    fires = F.coalesce(F.col("top") == 0, F.lit(False))
    won = F.coalesce("won", F.lit(False))
    return each.groupBy("cutoff").agg(count_true(fires).alias("stops"), count_true(fires & won).alias("false_negatives"), count_true(fires & ~won).alias("safe_stops"), F.sum(F.when(fires & ~won, F.col("after")).otherwise(0)).cast("bigint").alias("saved"))


def integrity(records: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """One row: keys missing between the least and the largest, keys that repeat, records without a file and files without a record."""
    n = records.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("c"))
    own = n.agg(F.count(F.lit(1)).alias("n_keys"), (F.max(key) - F.min(key) + 1 - F.count(F.lit(1))).alias("missing"), count_true(F.col("c") > 1).alias("repeated"))
    there = files.select(key).where(F.col(key).isNotNull()).distinct()
    gone = n.join(there, key, "left_anti").agg(F.count(F.lit(1)).alias("no_file"))
    extra = there.join(n, key, "left_anti").agg(F.count(F.lit(1)).alias("no_record"))
    return own.join(F.broadcast(gone)).join(F.broadcast(extra))  # one row each


def pck(df: DataFrame, predicted: Column, truth: Column, limits: list[float]) -> DataFrame:
    """(limit, correct, total): keypoints within each limit in pixels; a point with a negative coordinate on either side is skipped."""
    there = lambda p: (p[0] >= 0) & (p[1] >= 0)
    pairs = F.filter(F.arrays_zip(predicted.alias("a"), truth.alias("b")), lambda x: F.coalesce(there(x.a) & there(x.b), F.lit(False)))
    d = df.select(F.transform(pairs, lambda x: distance(x.a, x.b)).alias("d"))
    count = lambda limit: F.sum(F.size(F.filter("d", lambda x: x <= limit))).cast("bigint")
    within = [count(t) for t in limits]
    aggs = [F.struct(F.lit(float(t)).alias("limit"), c.alias("correct"), F.sum(F.size("d")).cast("bigint").alias("total")) for t, c in zip(limits, within, strict=True)]
    return d.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("x")).select("x.*")


def auc(df: DataFrame, error: Column, most: float, steps: int = 100) -> DataFrame:
    """One row: area under the share of errors below each of `steps` thresholds from 0 to most, by trapezoids, over most. Each row adds to the first
    threshold above it alone, and the shares are running sums over those few."""
    width = most / (steps - 1)
    grid = df.sparkSession.range(steps).select(F.col("id").alias("at"), (F.col("id") * F.lit(width)).alias("th"))
    e = df.select(error.alias("e"))
    first = F.floor(F.col("e") / width) + 1  # rounding may put it one step off
    first = F.when(F.col("e") < (first - 1) * width, first - 1).when(F.col("e") >= first * width, first + 1).otherwise(first)
    n = e.groupBy(F.when(F.col("e").isNotNull() & (first < steps), F.greatest(first, F.lit(0))).cast("bigint").alias("at")).agg(F.count(F.lit(1)).alias("c"))
    total = n.agg(F.sum("c").alias("n"))
    curve = grid.join(n, "at", "left").join(F.broadcast(total)).withColumn("y", F.sum(F.coalesce("c", F.lit(0))).over(Window.partitionBy().orderBy("at")) / F.col("n"))
    area = curve.withColumn("part", (F.col("y") + F.lag("y").over(Window.partitionBy().orderBy("at"))) / 2 * width)
    return area.agg((F.sum("part") / most).alias("auc"))


def pose_summary(df: DataFrame, add: Column, correct: Column, shift: Column, turn: Column) -> DataFrame:
    """One row: n, mean and median ADD, share correct, share under 5 cm and 5 degrees, mean errors."""
    ok = (shift < 0.05) & (turn < 5)
    out = agg_percentiles(
        df, [], add, [0.5], F.count(F.lit(1)).alias("n"), F.avg(add).alias("mean_add"), F.avg(F.when(correct, 1.0).otherwise(0.0)).alias("rate"),
        F.avg(F.when(ok, 1.0).otherwise(0.0)).alias("rate_5cm_5deg"), F.avg(shift).alias("mean_shift"), F.avg(turn).alias("mean_turn"),
    )
    return out.select("n", "mean_add", F.get("q", F.lit(0)).alias("median_add"), "rate", "rate_5cm_5deg", "mean_shift", "mean_turn")


def convergence(rounds: DataFrame, order: str, rate: str, eps: float = 0.01, patience: int = 3) -> DataFrame:
    """Rounds with the change of the rate, the run of small changes up to there, and whether training has converged there. Rounds are few."""
    w = Window.partitionBy().orderBy(order)
    d = rounds.withColumn("change", F.col(rate) - F.lag(rate).over(w)).withColumn("_small", F.coalesce(F.abs("change") < eps, F.lit(False)))
    d = d.withColumn("_island", F.sum((~F.col("_small")).cast("int")).over(w))
    d = d.withColumn("run", F.sum(F.col("_small").cast("bigint")).over(Window.partitionBy("_island").orderBy(order)))
    return d.withColumn("converged", F.max(F.col("run") >= patience).over(w)).drop("_small", "_island")


def canonical_sha(df: DataFrame, columns: list[str], volatile: tuple[str, ...] = (), paths: tuple[str, ...] = ()) -> Column:
    """SHA-256 of the compact JSON of a row: sorted keys, doubles as text with 9 digits, volatile columns left out, paths cut to their last part."""
    kinds = dict(df.dtypes)

    def value(c: str) -> Column:
        if c in paths:
            return F.substring_index(F.col(c), "/", -1)
        return F.format_string("%.9f", F.col(c)) if kinds[c] in ("double", "float") else F.col(c)

    return F.sha2(F.to_json(F.struct(*(value(c).alias(c) for c in sorted(set(columns) - set(volatile)))), {"ignoreNullFields": "false"}), 256)


def digest(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """(n, digest) of a stream of rows. Each row is hashed with its place in the order, so the sum of the hashes changes if rows change places, and it
    is added up without any sorting."""
    text = F.concat_ws("|", F.col(order).cast("string"), *(F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns))
    part = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(part), F.lit(0)).cast("decimal(38,0)").alias("digest"))


def tail_equal(a: DataFrame, b: DataFrame, order: str, columns: list[str], after) -> DataFrame:
    """One row: digests of both tails behind `after`, and whether a resumed run (b) went on like the uninterrupted one (a)."""
    x, y = (digest(df.where(F.col(order) > after), order, columns) for df in (a, b))
    both = x.join(F.broadcast(y.withColumnsRenamed({"n": "n_b", "digest": "digest_b"})))
    return both.withColumn("equal", (F.col("n") == F.col("n_b")) & (F.col("digest") == F.col("digest_b")))


def match_levels(package: DataFrame, tree: DataFrame, by: str) -> DataFrame:
    """Evidence for each pair (by) that a package (path, size, crc) is a tree: 1 counts agree, 2 bytes too, 3 paths and sizes too, 4 checksums too, else 0.
    The directory that all paths of a side share is cut off first."""

    def cut(df: DataFrame) -> DataFrame:
        # folders end with their slash: what the least and the largest share up to a slash, all between them share too
        folder = F.coalesce(F.left("path", F.length("path") - F.length(F.substring_index("path", "/", -1))), F.lit(""))
        ends = df.groupBy(by).agg(F.min(folder).alias("lo"), F.max(folder).alias("hi"))
        parts = F.split("lo", "/")
        other = F.array_position(F.zip_with(parts, F.split("hi", "/"), lambda x, y: x.eqNullSafe(y)), False).cast("int")
        shared = F.when(other == 1, 0).otherwise(F.least(F.length(F.array_join(F.slice(parts, F.lit(1), other - 1), "/")) + 1, F.length("lo")))
        cutoff = ends.select(by, F.when(F.col("lo") == F.col("hi"), F.length("lo")).otherwise(shared).alias("_n"))
        return df.join(cutoff, by).withColumn("path", F.expr("substring(path, _n + 1)")).drop("_n")

    p, t = cut(package), cut(tree)
    both = p.select(by, "path", F.lit(1).alias("in_p"), F.col("size").alias("sp"), F.col("crc").alias("cp")).join(t.select(by, "path", F.lit(1).alias("in_t"), F.col("size").alias("st"), F.col("crc").alias("ct")), [by, "path"], "full_outer")
    g = both.groupBy(by).agg(F.count("in_p").alias("n_p"), F.count("in_t").alias("n_t"), F.sum("sp").alias("bytes_p"), F.sum("st").alias("bytes_t"), F.min(F.coalesce(F.col("sp") == F.col("st"), F.lit(False))).alias("sizes"), F.min(F.coalesce((F.col("sp") == F.col("st")) & (F.col("cp") == F.col("ct")), F.lit(False))).alias("crcs"))
    level = F.when((F.col("n_p") == 0) | (F.col("n_p") != F.col("n_t")), 0).when(~F.coalesce(F.col("bytes_p") == F.col("bytes_t"), F.lit(False)), 1).when(~F.col("sizes"), 2).when(~F.col("crcs"), 3).otherwise(4)
    return g.select(by, level.alias("level"))
