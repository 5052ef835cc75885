"""Densities, kernel probabilities and resampling. Values are collapsed or binned first, then a grid of fixed size meets the few bins."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bessel_i0(x: float) -> float:
    """Modified Bessel function of order 0 times exp(-x): the mean of exp(x * (cos t - 1)), by the trapezoid rule."""
    n = 2000
    return sum(math.exp(x * (math.cos(2 * math.pi * i / n) - 1)) for i in range(n)) / n


def _grid(values: list[float]) -> Column:
    return F.explode(F.array(*map(F.lit, values)))


def angle_bins(df: DataFrame, angle: Column, bins: int) -> DataFrame:
    """(a, m): centres of equal bins of the circle, in radians, and rows in them; the first centre is 0."""
    width = 2 * math.pi / bins
    return df.where(angle.isNotNull()).groupBy((F.pmod(F.round(angle / width), F.lit(bins)) * width).alias("a")).agg(F.count(F.lit(1)).alias("m"))


def von_mises_kde(counts: DataFrame, points: int, kappa: float) -> DataFrame:
    """(grid, density) of angle_bins() on points of the circle."""
    e = counts.select("a", "m", _grid([2 * math.pi * i / points for i in range(points)]).alias("grid"))
    k = F.exp(kappa * (F.cos(F.col("grid") - F.col("a")) - 1)) / (2 * math.pi * bessel_i0(kappa))
    return e.groupBy("grid").agg((F.sum(F.col("m") * k) / F.sum("m")).alias("density"))


def select_kappa(counts: DataFrame, kappas: list[float]) -> DataFrame:
    """(kappa, score): mean leave-one-out log likelihood of the rows for each kappa, largest first. Work is bins * bins * kappas, whatever the rows."""
    n = counts.agg(F.sum("m").alias("n"))
    pairs = counts.join(F.broadcast(counts.withColumnsRenamed({"a": "b", "m": "w"})))  # bins of fixed number
    scale = F.explode(F.array(*(F.struct(F.lit(float(k)).alias("kappa"), F.lit(2 * math.pi * bessel_i0(k)).alias("z")) for k in kappas)))
    each = pairs.select("a", "b", "m", "w", scale.alias("s")).select("a", "b", "m", "w", "s.*")
    at = each.groupBy("kappa", "z", "a", "m").agg(F.sum(F.col("w") * F.exp(F.col("kappa") * (F.cos(F.col("a") - F.col("b")) - 1))).alias("x"))
    loo = (F.col("x") - 1) / F.col("z") / (F.col("n") - 1)
    return at.join(F.broadcast(n)).groupBy("kappa", "n").agg((F.sum(F.col("m") * F.log(F.greatest(loo, F.lit(1e-300))))).alias("s")).select("kappa", (F.col("s") / F.col("n")).alias("score")).orderBy(F.desc("score"), "kappa")


def binned_outcomes(df: DataFrame, x: Column, y: Column, lo: float, hi: float, bins: int) -> DataFrame:
    """(x, n, s): bin centres between lo and hi, rows and passes; rows outside are left out."""
    width = (hi - lo) / bins
    inside = df.where(x.between(lo, hi) & y.isNotNull())
    at = F.least(F.floor((x - lo) / width), F.lit(bins - 1))
    return inside.groupBy((F.lit(lo) + (at + 0.5) * width).alias("x")).agg(F.count(F.lit(1)).alias("n"), F.sum(y.cast("double")).alias("s"))


def kernel_probability(counts: DataFrame, grid: list[float], h: float, reliable: float = 20) -> DataFrame:
    """(grid, p, n_eff, reliable): Nadaraya-Watson estimate of the pass probability from binned_outcomes()."""
    e = counts.select("*", _grid([float(g) for g in grid]).alias("grid"))
    k = F.exp(-0.5 * F.pow((F.col("grid") - F.col("x")) / h, 2))
    g = e.groupBy("grid").agg(F.sum(k * F.col("n")).alias("a"), F.sum(k * F.col("s")).alias("b"), F.sum(k * k * F.col("n")).alias("c"))
    n_eff = F.try_divide(F.col("a") * F.col("a"), F.col("c"))
    return g.select("grid", F.try_divide("b", "a").alias("p"), n_eff.alias("n_eff"), (n_eff >= reliable).alias("reliable"))


def select_bandwidth(counts: DataFrame, lo: float, hi: float, steps: int = 25) -> DataFrame:
    """(h, brier): leave-one-out Brier score of each of `steps` bandwidths in geometric steps, least first."""
    hs = [lo * (hi / lo) ** (i / (steps - 1)) for i in range(steps)]
    pairs = counts.join(F.broadcast(counts.withColumnsRenamed({"x": "x2", "n": "n2", "s": "s2"}))).select("*", _grid(hs).alias("h"))
    k = F.exp(-0.5 * F.pow((F.col("x") - F.col("x2")) / F.col("h"), 2))
    at = pairs.groupBy("h", "x", "n", "s").agg(F.sum(k * F.col("n2")).alias("a"), F.sum(k * F.col("s2")).alias("b"))
    for_pass, for_fail = F.try_divide(F.col("b") - 1, F.col("a") - 1), F.try_divide(F.col("b"), F.col("a") - 1)
    loss = F.when(F.col("s") > 0, F.col("s") * F.pow(1 - for_pass, 2)).otherwise(0.0) + F.when(F.col("n") > F.col("s"), (F.col("n") - F.col("s")) * F.pow(for_fail, 2)).otherwise(0.0)
    return at.where(F.col("a") > 1 + 1e-9).groupBy("h").agg((F.sum(loss) / F.sum("n")).alias("brier")).orderBy("brier", "h")


#: The distribution function of a Poisson variable with mean 1, from 0 on.
POISSON = [math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(9)]


def hashed_uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts joined by |, the same on any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("double") / 4294967296.0


def bootstrap_means(df: DataFrame, key: str, value: str, replicates: int, seed: int = 0) -> DataFrame:
    """(replicate, mean): each row has a Poisson weight in each replicate that depends on its key alone, so nothing is drawn and nothing is
    collected. An MD5 of the key gives the weights of four replicates. A split adds up the weighted sums of all replicates as arrays and sends
    one row each on, however many rows it has."""
    blocks = F.sequence(F.lit(0), F.lit((replicates - 1) // 4))
    hashes = F.transform(blocks, lambda b: F.md5(F.concat_ws("|", F.col(key).cast("string"), b.cast("string"), F.lit(str(seed)))))
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"), F.array_join(hashes, "").alias("h"))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(replicates), np.zeros(replicates, np.int64)
        for b in batches:
            for at in range(0, len(b), 2000):
                part = b.slice(at, 2000)
                drawn = np.frombuffer(bytes.fromhex("".join(part.column("h").to_pylist())), ">u4").reshape(len(part), -1)[:, :replicates]
                w = np.searchsorted(POISSON, drawn / 4294967296.0, "right")
                total += part.column("v").to_numpy() @ w
                count += w.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(replicates), pa.int32()), pa.array(total), pa.array(count)], names=["replicate", "s", "n"])

    each = rows.mapInArrow(add_up, "replicate int, s double, n bigint").groupBy("replicate").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return each.select("replicate", F.try_divide("s", "n").alias("mean"))


def bootstrap_band(df: DataFrame, key: str, value: str, replicates: int, seed: int = 0) -> DataFrame:
    """One row: mean, and the 2.5 and 97.5 percentiles of the replicates' means, which are as few as asked for."""
    band = bootstrap_means(df, key, value, replicates, seed).agg(F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return df.agg(F.avg(value).alias("mean")).join(F.broadcast(band)).select("mean", F.get("q", F.lit(0)).alias("lo"), F.get("q", F.lit(1)).alias("hi"))


def _exact_kde2d(rows: DataFrame, box: tuple[float, float, float, float], points: int, circular: bool) -> DataFrame:
    """kde2d of rows (x, y, hx, hy), whose widths are the same everywhere."""
    x0, x1, y0, y1 = box
    line = lambda a, b: np.array([a + (b - a) * k / (points - 1) for k in range(points)])
    gx, gy = line(x0, x1), line(y0, y1)

    def kernel(grid: np.ndarray, v: np.ndarray, h: np.ndarray, lo: float, hi: float, wrap: bool) -> np.ndarray:
        images = (v, v - (hi - lo), v + (hi - lo)) if wrap else (v, 2 * lo - v, 2 * hi - v)
        return sum(np.exp(-0.5 * ((grid[:, None] - z) / h) ** 2) for z in images)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((points, points)), 0
        for b in batches:
            x, y, hx, hy = (b.column(k).to_numpy() for k in ("x", "y", "hx", "hy"))
            total += kernel(gx, x, hx, x0, x1, circular) @ kernel(gy, y, hy, y0, y1, False).T
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(gx, points)), pa.array(np.tile(gy, points)), pa.array(total.ravel())], names=["gx", "gy", "s"])

    s = rows.mapInArrow(add_up, "gx double, gy double, s double").groupBy("gx", "gy").agg(F.sum("s").alias("s"))
    return s.join(F.broadcast(s.agg(F.sum("s").alias("all")))).select("gx", "gy", (F.col("s") / F.col("all")).alias("density"))


def kde2d(df: DataFrame, x: str, y: str, box: tuple[float, float, float, float], points: int, bins: int | None = None, circular: bool = False) -> DataFrame:
    """(gx, gy, density) on a grid over box (x from, x to, y from, y to): Gaussian, Scott's factor, mirrored at the sides, summing to 1 over
    the grid; with circular, x goes round instead.

    Every row counts with its own place. The kernel is a product, so a batch of rows is the product of two matrices (rows by points), and a
    split sends the sums of all its rows on.

    If bins is given, a row adds to the four nearest nodes of a grid of bins instead, in proportion to its nearness (linear binning), which
    is counted where the rows are; the kernel is applied along x first and then along y: bins * bins * points and bins * points * points
    terms, however many rows there are.
    """
    x0, x1, y0, y1 = map(float, box)
    c = df.where(F.col(x).between(x0, x1) & F.col(y).between(y0, y1)).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    scale = c.agg(*((F.stddev_pop(v) * F.pow(F.count(F.lit(1)), F.lit(-1 / 6))).alias(f"h{v}") for v in "xy"))
    if bins is None:
        return _exact_kde2d(c.join(F.broadcast(scale)), (x0, x1, y0, y1), points, circular)  # one row is broadcast
    steps = bins if circular else bins - 1  # going round, the last node is the first

    def sides(v: str, lo: float, hi: float, n: int, wrap: bool) -> Column:
        at = (F.col(v) - lo) * (n / (hi - lo))
        low = F.least(F.floor(at), F.lit(n - 1))
        second = (low + 1) % n if wrap else low + 1
        return F.array(F.struct(low.alias("i"), (low + 1 - at).alias("w")), F.struct(second.alias("i"), (at - low).alias("w")))

    near = c.select(sides("x", x0, x1, steps, circular).alias("a"), sides("y", y0, y1, bins - 1, False).alias("b"))
    pairs = F.flatten(F.transform("a", lambda p: F.transform("b", lambda q: F.struct(p["i"].alias("i"), q["i"].alias("j"), (p["w"] * q["w"]).alias("w")))))
    cells = near.select(F.explode(pairs).alias("c")).groupBy("c.i", "c.j").agg(F.sum("c.w").alias("w")).where("w > 0")
    line = lambda a, b: [a + (b - a) * k / (points - 1) for k in range(points)]
    bell = lambda d, h: F.exp(-0.5 * F.pow(d / F.col(h), 2))

    def kernel(g: str, v: Column, lo: float, hi: float, h: str, wrap: bool) -> Column:
        images = (v, v - (hi - lo), v + (hi - lo)) if wrap else (v, 2 * lo - v, 2 * hi - v)
        return sum((bell(F.col(g) - z, h) for z in images[1:]), bell(F.col(g) - images[0], h))

    e = cells.join(F.broadcast(scale)).select("*", _grid(line(x0, x1)).alias("gx"))  # one row is broadcast
    u = x0 + F.col("i") * ((x1 - x0) / steps)
    across = e.groupBy("gx", "j").agg(F.sum(F.col("w") * kernel("gx", u, x0, x1, "hx", circular)).alias("w"))
    e = across.join(F.broadcast(scale)).select("*", _grid(line(y0, y1)).alias("gy"))
    v = y0 + F.col("j") * ((y1 - y0) / (bins - 1))
    s = e.groupBy("gx", "gy").agg(F.sum(F.col("w") * kernel("gy", v, y0, y1, "hy", False)).alias("s"))
    return s.join(F.broadcast(s.agg(F.sum("s").alias("all")))).select("gx", "gy", (F.col("s") / F.col("all")).alias("density"))


def ipf(cells: DataFrame, rows: DataFrame, columns: DataFrame, sweeps: int = 50, tol: float = 1e-12, save=None) -> DataFrame:
    """(r, c, p) with the marginals of rows (r, want) and columns (c, want), fitted from cells (r, c, p) by proportional scaling. Scales of rows and
    columns are kept apart from the cells, so a sweep is two aggregates; save(df) writes a table and reads it back after each sweep."""
    before = None
    for _ in range(sweeps):
        for key, want in (("r", rows), ("c", columns)):
            total = cells.groupBy(key).agg(F.sum("p").alias("_t"))
            cells = cells.join(total.join(want, key).select(key, F.try_divide("want", "_t").alias("_f")), key).select("r", "c", (F.col("p") * F.coalesce("_f", F.lit(0.0))).alias("p"))
        cells = save(cells) if save else cells
        off = cells.groupBy("r").agg(F.sum("p").alias("_t")).join(rows, "r").agg(F.max(F.abs(F.col("_t") - F.col("want")))).first()[0]
        if off is None or off <= tol or off == before:
            break
        before = off
    return cells
