"""Masks as run lengths, area ladders and arrays, as column expressions. Runs are column-major counts that start with background."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, StructType


def rle_valid(counts: Column, height: Column | int, width: Column | int) -> Column:
    """True if no count is negative and all sum up to the image."""
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda s, x: s + x)
    return F.forall(counts, lambda x: x >= 0) & (total == height * width)


def rle_runs(counts: Column) -> Column:
    """Foreground runs as array<struct<s, e>>, end excluded; empty runs are left out."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr("cast(array() as array<struct<s: bigint, e: bigint>>)").alias("runs"))
    numbered = F.transform(counts, lambda x, i: F.struct(x.cast("bigint").alias("n"), (i % 2 == 1).alias("on")))
    step = lambda a, x: F.struct((a.at + x.n).alias("at"), F.when(x.on & (x.n > 0), F.array_append(a.runs, F.struct(a.at.alias("s"), (a.at + x.n).alias("e")))).otherwise(a.runs).alias("runs"))
    return F.aggregate(numbered, start, step, lambda a: a.runs)


def _total(runs: Column, f) -> Column:
    return F.aggregate(F.transform(runs, f), F.lit(0).cast("bigint"), lambda s, x: s + x)


def rle_area(counts: Column) -> Column:
    return _total(rle_runs(counts), lambda r: r.e - r.s)


def mask_stats(runs: Column, height: int) -> Column:
    """area, left, top, right, bottom (all included) and centroid cx, cy of runs, from sums in closed form: no pixel is expanded."""
    column = lambda n: (F.expr("bigint(1)") * height * F.floor(n / height) * (F.floor(n / height) - 1) / 2 + F.floor(n / height) * (n % height)).cast("bigint")
    area = _total(runs, lambda r: r.e - r.s)
    xs = _total(runs, lambda r: column(r.e) - column(r.s))
    places = _total(runs, lambda r: ((r.e * (r.e - 1) - r.s * (r.s - 1)) / 2).cast("bigint"))
    same = lambda r: F.floor(r.s / height) == F.floor((r.e - 1) / height)
    out = F.struct(
        area.alias("area"),
        F.array_min(F.transform(runs, lambda r: F.floor(r.s / height))).alias("left"),
        F.array_min(F.transform(runs, lambda r: F.when(same(r), r.s % height).otherwise(0))).alias("top"),
        F.array_max(F.transform(runs, lambda r: F.floor((r.e - 1) / height))).alias("right"),
        F.array_max(F.transform(runs, lambda r: F.when(same(r), (r.e - 1) % height).otherwise(height - 1))).alias("bottom"),
        F.try_divide(xs, area).alias("cx"),
        F.try_divide(places - height * xs, area).alias("cy"),
    )
    return F.when(F.size(runs) > 0, out)


def overlap(a: Column, b: Column) -> Column:
    """Places that both sets of runs have."""
    both = lambda x: _total(b, lambda y: F.greatest(F.lit(0), F.least(x.e, y.e) - F.greatest(x.s, y.s)))
    return _total(a, both)


def inclusion_violation(inner: Column, outer: Column) -> Column:
    """Places of inner that outer lacks, and their share of inner (null where inner is empty)."""
    area = _total(inner, lambda r: r.e - r.s)
    lost = area - overlap(inner, outer)
    return F.struct(lost.alias("violation_px"), F.try_divide(lost, area).alias("ratio"))


def decompose_areas(areas: list[Column], names: list[str], tolerance: float = 1e-9) -> Column:
    """Shares that each stage takes of the first area (areas fall from stage to stage), their total, and the invariants that fail."""
    first, last = areas[0], areas[-1]
    parts = [F.when(first > 0, F.greatest(F.lit(0.0), (a - b).cast("double")) / first) for a, b in zip(areas, areas[1:], strict=False)]
    total = F.when(first > 0, (first - last).cast("double") / first)
    grows = [F.when(b > a, F.lit(f"{n}_grows")) for n, a, b in zip(names, areas, areas[1:], strict=False)]
    sums = F.when(F.abs(sum(parts[1:], parts[0]) - total) > tolerance, F.lit("sum_differs"))
    return F.struct(*(p.alias(n) for n, p in zip(names, parts, strict=True)), total.alias("total"), F.array_compact(F.array(*grows, sums)).alias("errors"))


def corner_gates(in_frame: Column, self_visible: Column, occlusion: Column, cut: float = 0.5) -> Column:
    """Of corners in the frame that the object does not hide itself: visible and externally occluded ones, both gates and the least distance to the cut."""
    flags = F.arrays_zip(in_frame.alias("i"), self_visible.alias("s"), occlusion.alias("o"))
    seen = F.filter(flags, lambda c: c.i & c.s)
    visible, hidden = F.size(F.filter(seen, lambda c: c.o < cut)), F.size(F.filter(seen, lambda c: c.o >= cut))
    gap = F.array_min(F.transform(seen, lambda c: F.abs(c.o - cut)))
    return F.struct(visible.alias("visible"), hidden.alias("occluded"), (visible >= 4).alias("g1"), hidden.between(1, 4).alias("g2"), gap.alias("gap"))


def array_diff(a: Column, b: Column, peak: float = 1.0) -> Column:
    """Whether two arrays have one length, how many numbers differ, the first place, largest and mean difference, share, and PSNR (null if equal)."""
    d = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    n = F.size(F.filter(d, lambda x: x > 0))
    total = lambda f: F.aggregate(F.transform(d, f), F.lit(0.0), lambda s, x: s + x)
    mse = total(lambda x: x * x) / F.size(d)
    return F.struct(
        (F.size(a) == F.size(b)).alias("same_shape"),
        n.alias("n_diff"),
        F.when(n > 0, F.array_position(F.transform(d, lambda x: x > 0), F.lit(True))).alias("first"),
        F.array_max(d).alias("max_abs"),
        (total(lambda x: x) / F.size(d)).alias("mean_abs"),
        (n / F.size(d)).alias("share"),
        F.when(mse > 0, 10 * F.log10(peak * peak / mse)).alias("psnr"),
    )


def nonfinite_paths(c: Column, kind: DataType, path: str) -> Column:
    """Paths of NaN and infinite numbers anywhere in a nested value; places in arrays count from 0. Depth comes from the type alone."""
    bad = lambda x: F.isnan(x) | (F.abs(x) == float("inf"))
    none = F.expr("cast(array() as array<string>)")
    if isinstance(kind, (DoubleType, FloatType)):
        return F.when(bad(c), F.array(F.lit(path))).otherwise(none)
    if isinstance(kind, StructType):
        parts = [nonfinite_paths(c[f.name], f.dataType, f"{path}.{f.name}" if path else f.name) for f in kind.fields]
        return F.concat(*parts) if parts else none
    if isinstance(kind, ArrayType):
        inner = F.flatten(F.transform(c, lambda x, i: F.transform(nonfinite_paths(x, kind.elementType, ""), lambda p: F.concat(F.lit(f"{path}["), i.cast("string"), F.lit("]"), p))))
        return F.coalesce(inner, none)
    return none


def geometry_key(names: list[Column], numbers: list[Column]) -> Column:
    """Names and numbers with 6 digits, joined by |; what is missing is -."""
    return F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("-")) for c in names), *(F.coalesce(F.format_string("%.6f", c.cast("double")), F.lit("-")) for c in numbers))
