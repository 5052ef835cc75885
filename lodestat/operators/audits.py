"""Audits of a delivered set: duplicates by stage, directories, leaks, quotas, joint shares, config decisions, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StringType, StructType

from lodestat.functions.scalars import count_true
from lodestat.operators.tables import agg_percentiles, path_prefixes, percentiles

ALL_BLACK = "__all_black__"
#: The failures that a class of duplicates adds to its frames.
FAILURES = {"stale_or_mismatched": "mask_stale_cross_frame_duplicate", "unverifiable": "mask_duplicate_geometry_unverifiable"}


def stage_duplicates(df: DataFrame, stage: str, content: str, area: str, file_hash: str, signature: list[str], target: str) -> DataFrame:
    """(stage, key, n, byte_identical, class) of contents that several rows of a stage share. Empty masks (area 0) of a stage are one content.

    class: empty_target (empty masks of the target stage), all_black (of another), stale_or_mismatched (a signature column differs),
    unverifiable (one is unknown somewhere), else identical_geometry."""
    key = F.when(F.col(area) == 0, ALL_BLACK).otherwise(F.col(content))
    ends = [F.struct(F.min(c).alias("lo"), F.max(c).alias("hi"), F.count(c).alias("n")).alias(f"s{i}") for i, c in enumerate([*signature, file_hash])]
    g = df.where(key.isNotNull()).groupBy(stage, key.alias("key")).agg(F.count(F.lit(1)).alias("n"), *ends).where("n > 1")
    own = [F.col(f"s{i}") for i in range(len(signature))]
    differs = reduce(lambda a, b: a | b, (F.coalesce(s["lo"] != s["hi"], F.lit(False)) for s in own))
    unknown = reduce(lambda a, b: a | b, (s["n"] < F.col("n") for s in own))
    file = F.col(f"s{len(signature)}")
    black = F.col("key") == ALL_BLACK
    kind = F.when(black & (F.col(stage) == target), "empty_target").when(black, "all_black").when(differs, "stale_or_mismatched").when(unknown, "unverifiable").otherwise("identical_geometry")
    same = F.coalesce((file["lo"] == file["hi"]) & (file["n"] == F.col("n")), F.lit(False))
    return g.select(stage, "key", "n", same.alias("byte_identical"), kind.alias("class"))


def fold_duplicates(df: DataFrame, frame: str, stage: str, content: str, area: str, groups: DataFrame) -> DataFrame:
    """One row a frame: the stages and classes in which it has duplicates, and the failures that follow, each sorted and joined by ;."""
    key = F.when(F.col(area) == 0, ALL_BLACK).otherwise(F.col(content))
    rows = df.select(frame, F.col(stage).alias("_stage"), key.alias("_key"))
    j = rows.join(groups.select(F.col(stage).alias("_stage"), F.col("key").alias("_key"), "class"), ["_stage", "_key"], "left")
    failure = F.coalesce(*(F.when(F.col("class") == k, v) for k, v in FAILURES.items()))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ";")
    return j.groupBy(frame).agg(joined(F.when(F.col("class").isNotNull(), F.col("_stage"))).alias("stages"), joined(F.col("class")).alias("classes"), joined(failure).alias("failures"))


def within_duplicates(df: DataFrame, frame: str, stage: str, content: str, state: str) -> DataFrame:
    """(frame, stages, verdict) of stages of one frame with equal content: unverifiable if the state of one is unknown, stale if they span
    several states (the content should have changed), else expected. A frame has few stages."""
    g = df.groupBy(frame, F.col(content).alias("_c")).agg(F.array_sort(F.collect_list(stage)).alias("all"), F.count(F.lit(1)).alias("n"), F.count(state).alias("k"), F.min(state).alias("lo"), F.max(state).alias("hi")).where("n > 1")
    verdict = F.when(F.col("k") < F.col("n"), "unverifiable").when(F.col("lo") != F.col("hi"), "stale").otherwise("expected")
    return g.select(frame, F.array_join("all", "|").alias("stages"), verdict.alias("verdict"))


def dir_signature(files: DataFrame, top: Column, path: str, size: str, mtime: str, flags: dict[str, Column]) -> DataFrame:
    """One row a directory: files, bytes, first and last mtime, extensions with their counts (`ext:n`, sorted), and a flag each that some file
    sets. Files are counted by extension first."""
    name = F.substring_index(F.col(path), "/", -1)
    ext = F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise("")
    each = files.groupBy(top.alias("top"), ext.alias("ext")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b"), F.min(mtime).alias("lo"), F.max(mtime).alias("hi"), *(F.bool_or(F.coalesce(c, F.lit(False))).alias(k) for k, c in flags.items()))
    kinds = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ext", "n"))), lambda x: F.concat(x["ext"], F.lit(":"), x["n"].cast("string"))), ",")
    return each.groupBy("top").agg(F.sum("n").alias("files"), F.sum("b").alias("bytes"), F.min("lo").alias("first"), F.max("hi").alias("last"), kinds.alias("extensions"), *(F.bool_or(k).alias(k) for k in flags))


def release_leaks(entries: DataFrame, release: DataFrame, path: str) -> DataFrame:
    """(entry, leaked, how): places of a release that an exclusion list forbids, by their whole path, or as a directory with the entry's name.
    Paths of the release are exploded to their ancestors once, and both checks are equi-joins."""
    own = entries.select(F.rtrim(F.replace(F.col(path), F.lit("\\"), F.lit("/")), F.lit("/")).alias("entry")).where("entry <> ''").distinct()
    own = own.withColumn("name", F.substring_index("entry", "/", -1))
    places = release.select(F.posexplode(path_prefixes(F.col(path))).alias("i", "leaked"), F.size(F.split(path, "/")).alias("n"))
    places = places.select("leaked", (F.col("i") < F.col("n") - 1).alias("is_dir")).groupBy("leaked").agg(F.bool_or("is_dir").alias("is_dir"))
    whole = places.join(own, F.col("leaked") == F.col("entry")).select("entry", "leaked", F.lit("path").alias("how"))
    named = places.where("is_dir").withColumn("last", F.substring_index("leaked", "/", -1)).join(own, F.col("last") == F.col("name")).where("leaked <> entry")
    return whole.union(named.select("entry", "leaked", F.lit("name").alias("how")))


def cell_rates(df: DataFrame, row: str, col: str, accepted: Column, prescribed: DataFrame) -> DataFrame:
    """(row, col, n, share, ratio, reject_rate) of every prescribed cell (row, col, want): accepted rows, their share of all accepted ones, that
    over the prescribed share (null where nothing is prescribed), and the share of the cell's rows that are not accepted."""
    ok = F.coalesce(accepted, F.lit(False))
    n = df.groupBy(row, col).agg(count_true(ok).alias("n"), F.count(F.lit(1)).alias("_tried"))
    total = n.agg(F.sum("n").alias("_all"))
    j = prescribed.join(n, [row, col], "left").na.fill(0, ["n", "_tried"]).join(F.broadcast(total))  # one row
    share = F.try_divide("n", "_all")
    return j.select(row, col, "n", share.alias("share"), F.when(F.col("want") > 1e-12, share / F.col("want")).alias("ratio"), F.try_divide(F.col("_tried") - F.col("n"), F.col("_tried")).alias("reject_rate"))


def reason_lists(df: DataFrame, by: Column, reason: str) -> DataFrame:
    """(bin, reasons): `reason:n`, most frequent first."""
    n = df.where(F.col(reason).isNotNull()).groupBy(by.alias("bin"), reason).agg(F.count(F.lit(1)).alias("n"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(reason).cast("string").alias("r"))))
    return n.groupBy("bin").agg(F.array_join(F.transform(order, lambda x: F.concat(x["r"], F.lit(":"), (-x["m"]).cast("string"))), ",").alias("reasons"))


def given_marginals(df: DataFrame, axis: str, given: Column, prescribed: DataFrame, accepted: Column, within: float = 0.02) -> DataFrame:
    """(key, prescribed, accepted_frac, abs_error, ok, worst) of an axis that counts only where `given` holds, which is its denominator;
    ok: the error is at most `within`; worst: no key has a larger one. prescribed: (key, prescribed)."""
    rows = df.where(F.coalesce(given & accepted, F.lit(False))).groupBy(F.col(axis).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    all_n = rows.agg(F.sum("n").alias("_n"))
    j = prescribed.join(rows, "key", "left").na.fill(0, ["n"]).join(F.broadcast(all_n))  # one row
    j = j.withColumn("accepted_frac", F.try_divide("n", "_n")).withColumn("abs_error", F.abs(F.col("accepted_frac") - F.col("prescribed")))
    top = j.agg(F.max("abs_error").alias("_top"))
    return j.join(F.broadcast(top)).select("key", "prescribed", "accepted_frac", "abs_error", (F.col("abs_error") <= within).alias("ok"), (F.col("abs_error") == F.col("_top")).alias("worst"))


def config_decision(runs: DataFrame, protected: DataFrame, baseline, median_slack: float = 0.01, p95_slack: float = 0.02) -> DataFrame:
    """Per config of runs (config, case, accepted, error, cost): accepted cases, cost, protected cases that are lost (sorted, joined by |), whether
    the median and the 95 % quantile of the accepted cases' errors stay within the slack of the baseline's, whether it is eligible (nothing
    lost, quality kept, not the baseline itself), and the winner: the cheapest eligible one, then the first by name."""
    ok = F.coalesce("accepted", F.lit(False))
    out = agg_percentiles(runs, ["config"], F.when(ok, F.col("error")), [0.5, 0.95], count_true(ok).alias("n_accepted"), F.sum("cost").alias("cost"))
    out = out.withColumns({"median": F.get("q", F.lit(0)), "p95": F.get("q", F.lit(1))}).drop("q")
    keep = protected.select("case").distinct()
    there = runs.join(keep, "case", "left_semi").groupBy("config", "case").agg(F.max(ok).alias("ok"))
    kept = there.where("ok").groupBy("config").agg(F.collect_set("case").alias("_kept"))
    names = keep.agg(F.collect_set("case").alias("_all"))  # the protected set is a short list, which the result names in part
    out = out.join(kept, "config", "left").join(F.broadcast(names))
    gone = F.array_sort(F.array_except("_all", F.coalesce("_kept", F.array_except("_all", "_all"))))
    base = out.where(F.col("config") == baseline).select(F.col("median").alias("_m"), F.col("p95").alias("_p"))
    out = out.withColumn("lost", gone).join(F.broadcast(base), F.lit(True), "left")  # one row
    within = lambda a, b, slack: F.coalesce(F.col(a) <= F.col(b) + slack, F.lit(True))
    out = out.withColumn("quality", within("median", "_m", median_slack) & within("p95", "_p", p95_slack))
    out = out.withColumn("eligible", (F.size("lost") == 0) & F.col("quality") & (F.col("config") != baseline))
    best = out.where("eligible").agg(F.min_by("config", F.struct("cost", "config")).alias("_w"))
    out = out.join(F.broadcast(best))  # one row
    return out.select("config", "n_accepted", "cost", "median", "p95", F.array_join(F.transform("lost", lambda x: x.cast("string")), "|").alias("lost"), "quality", "eligible", F.coalesce(F.col("config") == F.col("_w"), F.lit(False)).alias("winner"))


def quota_report(df: DataFrame, cell: str, quotas: DataFrame) -> DataFrame:
    """(cell, quota, candidates, accepted, deficit, overflow) for every cell of quotas (cell, quota)."""
    n = df.groupBy(cell).agg(F.count(F.lit(1)).alias("candidates"))
    j = quotas.join(n, cell, "left").na.fill(0, ["candidates"])
    c, q, zero = F.col("candidates"), F.col("quota"), F.lit(0)
    return j.select(cell, "quota", "candidates", F.least(c, q).alias("accepted"), F.greatest(q - c, zero).alias("deficit"), F.greatest(c - q, zero).alias("overflow"))


def fill_subset(df: DataFrame, key: str, rules: dict[str, Column], protected: Column, cost: str, cap: int, least: int) -> DataFrame:
    """(key, reasons): rows that a rule picks or that are protected. Over the cap the protected ones stay first, then those with the least keys;
    under `least` rows the dearest others fill up, with the reason cost_fill. At most cap + least rows are ranked."""
    guard = F.coalesce(protected, F.lit(False))
    names = F.array_compact(F.array(F.when(guard, "protected"), *(F.when(c, F.lit(k)) for k, c in rules.items())))
    all_rows = df.select(key, F.col(cost).alias("_cost"), names.alias("_r"), guard.alias("_g"))
    picked = all_rows.where(F.size("_r") > 0).orderBy(F.desc("_g"), key).limit(cap)
    missing = picked.agg(F.greatest(F.lit(least) - F.count(F.lit(1)), F.lit(0)).alias("_m"))
    rest = all_rows.where(F.size("_r") == 0).orderBy(F.desc_nulls_last("_cost"), key).limit(least)
    ranked = rest.agg(F.array_sort(F.collect_list(F.struct((-F.coalesce("_cost", F.lit(float("-inf")))).alias("c"), key))).alias("a")).select(F.posexplode("a").alias("i", "x"))
    fill = ranked.join(F.broadcast(missing)).where("i < _m").select(f"x.{key}", F.lit("cost_fill").alias("reasons"))
    return picked.select(key, F.array_join("_r", "|").alias("reasons")).union(fill)


def wide_stats(df: DataFrame, fractions: dict[str, Column], distinct: list[str], arrays: dict[str, Column], ps: dict[str, tuple[str, float]]) -> DataFrame:
    """(statistic, value): share of rows with each flag, distinct counts, the 99 % quantile over all values of each array, and the named
    quantiles (column, p)."""
    parts = df.agg(*((count_true(c) / F.count(F.lit(1))).alias(k) for k, c in fractions.items()), *(F.count_distinct(c).cast("double").alias(f"distinct_{c}") for c in distinct))
    out = parts.unpivot([], parts.columns, "statistic", "value")
    for k, c in arrays.items():
        q = percentiles(df.select(F.explode(c).alias("v")), [], "v", [0.99])
        out = out.union(q.select(F.lit(f"p99_{k}"), F.get("q", F.lit(0))))
    for k, (c, p) in ps.items():
        out = out.union(percentiles(df, [], c, [p]).select(F.lit(k), F.get("q", F.lit(0))))
    return out


def probe_verdict(df: DataFrame, by: str, order: list[str], value: str, kind: str, wanted: str, edge: str, tol: float, n: int) -> DataFrame:
    """One row a group of ordered probes: how many, those of another kind, the largest step of the value, the least margin to the edge, and
    whether all is right: n probes of the wanted kind, every step within tol, no margin below 0. Pairs with an unknown value are skipped; a
    group's probes are few."""
    probes = F.array_sort(F.collect_list(F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), F.col(value).alias("v"))))
    g = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col(kind).eqNullSafe(wanted)).alias("kind_failures"), F.min(edge).alias("edge_margin"), probes.alias("p"))
    steps = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.abs(F.get("p", i)["v"] - F.get("p", i - 1)["v"]))
    g = g.withColumn("max_step", F.when(F.size("p") > 1, F.array_max(steps)))
    ok = (F.col("n") == n) & (F.col("kind_failures") == 0) & (F.col("max_step") <= tol) & (F.col("edge_margin") >= 0)
    return g.select(by, "n", "kind_failures", "max_step", "edge_margin", F.coalesce(ok, F.lit(False)).alias("ok"))


def label_issues(df: DataFrame, visibility: str, corners: Column, least: float = 0.5, count: int = 8) -> DataFrame:
    """df with issues of a label's object: LOW_VISIBILITY below `least` or unknown, CUBOID_LENGTH unless there are `count` corners."""
    low = ~F.coalesce(F.col(visibility) >= least, F.lit(False))
    wrong = ~F.coalesce(F.size(corners) == count, F.lit(False))
    return df.withColumn("issues", F.array_join(F.array_compact(F.array(F.when(low, "LOW_VISIBILITY"), F.when(wrong, "CUBOID_LENGTH"))), "|"))


def bitmask(flags: Column) -> Column:
    """Flags as the bits of a number, the first the lowest; unknown counts as unset."""
    bits = F.transform(flags, lambda f, i: F.when(F.coalesce(f, F.lit(False)), F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))


# canonical text


def canonical(value: Column, kind: DataType, volatile: tuple[str, ...] = (), paths: tuple[str, ...] = (), digits: int = 9, name: str = "") -> Column:
    """value with struct fields and map keys sorted, volatile ones left out, doubles as text with fixed digits, and fields named in paths cut to
    their last part, at any depth."""
    inner = lambda v, t, n="": canonical(v, t, volatile, paths, digits, n)
    if isinstance(kind, StructType):
        fields = sorted((f for f in kind.fields if f.name not in volatile), key=lambda f: f.name)
        return F.when(value.isNotNull(), F.struct(*(inner(value[f.name], f.dataType, f.name).alias(f.name) for f in fields)) if fields else F.struct(F.lit(0).alias("_")))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: inner(x, kind.elementType, name))
    if isinstance(kind, MapType):
        entries = F.array_sort(F.filter(F.map_keys(value), lambda k: ~k.cast("string").isin(*volatile) if volatile else F.lit(True)))
        return F.when(value.isNotNull(), F.map_from_arrays(entries, F.transform(entries, lambda k: inner(F.try_element_at(value, k), kind.valueType))))
    if isinstance(kind, (DoubleType, FloatType)):
        return F.when(value.isNotNull(), F.format_string(f"%.{digits}f", value + F.lit(0.0)))
    if isinstance(kind, StringType) and name in paths:
        return F.substring_index(value, "/", -1)
    return value


def nested_sha(df: DataFrame, key: str, parts: dict[str, list[str]], volatile: tuple[str, ...] = (), paths: tuple[str, ...] = ()) -> DataFrame:
    """key, and for each part the SHA-256 of the canonical compact JSON of its columns; sha is that of all of them."""
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def sha(columns: list[str]) -> Column:
        own = sorted(c for c in set(columns) if c not in volatile)
        return F.sha2(F.to_json(F.struct(*(canonical(F.col(c), kinds[c], volatile, paths, name=c).alias(c) for c in own)), {"ignoreNullFields": "false"}), 256)

    every = [c for own in parts.values() for c in own]
    return df.select(key, *(sha(own).alias(f"sha_{name}") for name, own in parts.items()), sha(every).alias("sha"))
