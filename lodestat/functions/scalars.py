"""Column expressions for missing values, typed access, bins and intervals. Unknown is never a pass; 0 and False are never missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(c: Column, kind: str = "double") -> Column:
    """c, or null where it is missing: null, a blank string, NaN or infinite."""
    if kind == "string":
        return F.when(F.trim(c) != "", c)
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c) if kind == "double" else c


def pick(*cols: Column) -> Column:
    """The first column that is not missing."""
    return F.coalesce(*cols)


def as_float(c: Column) -> Column:
    return present(c.try_cast("double"))


def as_int(c: Column) -> Column:
    return as_float(c).try_cast("bigint")


def as_bool(c: Column, mode: str = "wide") -> Column:
    """wide reads 1/yes/y/true and 0/no/n/false and any number; strict reads true and false alone."""
    t = F.lower(F.trim(c.cast("string")))
    if mode == "strict":
        return F.when(t == "true", True).when(t == "false", False)
    n = t.try_cast("double")
    return F.when(t.isin("true", "yes", "y"), True).when(t.isin("false", "no", "n"), False).when(n.isNotNull() & ~F.isnan(n), n != 0)


def group_label(c: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(c.cast("string")), F.lit("")), F.lit("(missing)"))


def numeric_bin(c: Column, cuts: list[float], prefix: str) -> Column:
    """prefix [lo,hi) of half-open bins; below the first and above the last cut the bin is open."""
    out = F.when(c < cuts[0], f"{prefix} <{cuts[0]:g}")
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        out = out.when((c >= lo) & (c < hi), f"{prefix} [{lo:g},{hi:g})")
    return out.when(c >= cuts[-1], f"{prefix} >={cuts[-1]:g}")


def bin_index(c: Column, edges: list[float]) -> Column:
    """Number of the half-open bin [edges[i], edges[i+1]) of c, the last one closed; null outside."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        inside = (c >= edges[i]) & ((c < edges[i + 1]) if i < len(edges) - 2 else (c <= edges[i + 1]))
        out = F.when(inside, i).otherwise(out)
    return out


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Ends of the Wilson interval of k of n; null where n is 0."""
    p, zz = F.try_divide(k, n), z * z
    mid, half = (p + zz / (2 * n)), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    return F.when(n > 0, F.greatest((mid - half) / (1 + zz / n), F.lit(0.0))), F.when(n > 0, F.least((mid + half) / (1 + zz / n), F.lit(1.0)))


def share_true(flag: Column) -> Column:
    """Aggregate: share of rows where flag is true; unknown counts as not true."""
    return F.avg(F.when(flag, 1.0).otherwise(0.0))


def count_true(flag: Column) -> Column:
    return F.sum(F.when(flag, 1).otherwise(0)).cast("bigint")


def argmax_label(parts: dict[str, Column]) -> Column:
    """Name of the largest part, the first of equals; none if it is 0, (missing) if all are null."""
    best = F.array_max(F.array(*(F.when(c.isNotNull(), F.struct(c.cast("double").alias("v"), F.lit(-i).alias("o"), F.lit(k).alias("k"))) for i, (k, c) in enumerate(parts.items()))))
    return F.when(best.isNull(), "(missing)").when(best.v == 0, "none").otherwise(best.k)


def conditions(named: dict[str, Column]) -> tuple[Column, Column]:
    """(failed, unknown): lists of the names whose condition is false or null."""
    pack = lambda test: F.array_compact(F.array(*(F.when(test(c), F.lit(k)) for k, c in named.items())))
    return pack(lambda c: c == F.lit(False)), pack(lambda c: c.isNull())


def all_pass(*flags: Column) -> Column:
    return F.coalesce(reduce(lambda a, b: a & b, flags), F.lit(False))


def erf(x: Column) -> Column:
    """Error function by the polynomial 7.1.26 of Abramowitz and Stegun; absolute error under 1.5e-7."""
    t = 1 / (1 + 0.3275911 * F.abs(x))
    poly = reduce(lambda acc, a: acc * t + a, (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592), F.lit(0.0))
    return F.signum(x) * (1 - poly * t * F.exp(-x * x))


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on key and seed alone."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
