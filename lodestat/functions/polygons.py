"""Hulls of few points, clipped to rectangles. Points are arrays of [x, y]; a batch of rows is computed at once in numpy, step by step for all
of its polygons, so a row costs microseconds and no expression is interpreted for it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Points, padding included, that are computed at once.
CELLS = 1 << 18


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _numbers(a: pa.Array) -> np.ndarray:
    """Doubles with nan for null."""
    return a.to_numpy(zero_copy_only=False).astype(float)


def _coordinates(a: pa.Array, width: int) -> np.ndarray:
    """(rows, width): the first coordinates of arrays of numbers, nan for a row that is null or has fewer."""
    at, flat = a.offsets.to_numpy(), _numbers(a.values)
    whole = np.flatnonzero((np.diff(at) >= width) & a.is_valid().to_numpy(zero_copy_only=False))
    out = np.full((len(a), width), np.nan)
    out[whole] = flat[at[whole][:, None] + np.arange(width)]
    return out


def _sets(points: pa.Array, width: int = 2) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, points, sizes): the rows of a batch in slices of about equal size; points as (rows, most points, width), a row's last point
    repeated up to there. Rows with a point or coordinate that is null or not finite are left out."""
    start = points.offsets.to_numpy()
    xy = _coordinates(points.values, width)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(xy).all(1))])
    good = points.is_valid().to_numpy(zero_copy_only=False) & (bad[start[1:]] == bad[start[:-1]])
    sizes = np.diff(start)
    rows = np.flatnonzero(good)
    rows = rows[np.argsort(sizes[rows], kind="stable")]
    while len(rows):
        n = max(1, int(np.searchsorted(np.arange(1, len(rows) + 1) * np.maximum(sizes[rows], 1), CELLS, "right")))
        now, rows = rows[:n], rows[n:]
        most = max(1, sizes[now[-1]])
        place = start[now][:, None] + np.minimum(np.arange(most), np.maximum(sizes[now] - 1, 0)[:, None])
        yield now, xy[np.minimum(place, len(xy) - 1)] if len(xy) else np.zeros((len(now), 1, width)), sizes[now]


def hulls(p: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(corners, number of corners) of convex hulls, counter-clockwise from the lowest of the leftmost points; fewer than three for points on
    a line. From each corner the next one is that which has all points to its left, the farthest of several; all rows go on together."""
    n, most = p.shape[:2]
    row = np.arange(n)
    first = np.zeros(n, int)
    for j in range(1, most):
        here, best = p[:, j], p[row, first]
        first = np.where((here[:, 0] < best[:, 0]) | ((here[:, 0] == best[:, 0]) & (here[:, 1] < best[:, 1])), j, first)
    begin = p[row, first]
    corners, count, now, open_ = [begin], np.minimum(sizes, 1), begin, sizes > 0
    for _ in range(most):
        to = now
        for j in range(most):
            q = p[:, j]
            a, b = to - now, q - now
            turn = a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]
            better = (turn < 0) | ((turn == 0) & ((b * b).sum(1) > (a * a).sum(1)))
            to = np.where(better[:, None], q, to)
        open_ = open_ & (to != begin).any(1) & (to != now).any(1)
        if not open_.any():
            break
        now = np.where(open_[:, None], to, now)
        corners.append(now)
        count = count + open_
    return np.stack(corners, 1), np.minimum(count, sizes)


def clip(p: np.ndarray, count: np.ndarray, box: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of convex polygons inside rectangles (rows of x0, y0, x1, y1), one side after another; empty if less than a triangle is left."""
    for axis, sign, at in ((0, 1.0, box[:, 0]), (0, -1.0, box[:, 2]), (1, 1.0, box[:, 1]), (1, -1.0, box[:, 3])):
        place = np.arange(p.shape[1])
        there = place < count[:, None]
        q = np.take_along_axis(p, ((place + 1) % np.maximum(count, 1)[:, None])[:, :, None], 1)
        a, b = (p[:, :, axis] - at[:, None]) * sign, (q[:, :, axis] - at[:, None]) * sign
        with np.errstate(divide="ignore", invalid="ignore"):
            cross = p + (a / (a - b))[:, :, None] * (q - p)
        cut = there & ((a >= 0) != (b >= 0))
        out = np.stack([p, np.where(cut[:, :, None], cross, p)], 2).reshape(len(p), -1, 2)
        kept = np.stack([there & (a >= 0), cut], 2).reshape(len(p), -1)
        count = kept.sum(1)
        order = np.argsort(~kept, 1, kind="stable")[:, : max(1, count.max(initial=0))]
        p = np.take_along_axis(out, order[:, :, None], 1)
    return p, np.where(count >= 3, count, 0)


def areas(p: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Areas of polygons in counter-clockwise order; 0 for less than a triangle."""
    own = p - p[:, :1]
    there = np.arange(p.shape[1] - 1) < count[:, None] - 1
    part = own[:, :-1, 0] * own[:, 1:, 1] - own[:, 1:, 0] * own[:, :-1, 1]
    return np.where(count < 3, 0.0, np.where(there, part, 0.0).sum(1) / 2)


def bounds(p: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Rows of x0, y0, x1, y1 of polygons; nan for those without points."""
    there = (np.arange(p.shape[1]) < count[:, None])[:, :, None]
    both = np.concatenate([np.where(there, p, np.inf).min(1), np.where(there, p, -np.inf).max(1)], 1)
    return np.where((count > 0)[:, None], both, np.nan)


_POINTS = "array<array<double>>"


def hull_area(points: Column) -> Column:
    """Area of the convex hull; 0 for less than a triangle, null if a point has a coordinate that is null or not finite."""

    @F.arrow_udf("double")
    def measured(points: pa.Array) -> pa.Array:
        out = np.full(len(points), np.nan)
        for rows, p, sizes in _sets(points):
            out[rows] = areas(*hulls(p, sizes))
        return pa.array(out, mask=np.isnan(out))

    return measured(points.cast(_POINTS))


def hull_in_image(points: Column, width: Column | float, height: Column | float, box: Column | None = None) -> Column:
    """area of the hull, area of its part inside the image (both 0 for less than a triangle), and its IoU with a box (x0, y0, x1, y1), the
    clipped hull's own bounds if none is given; null where both are empty. Points are rounded to 6 digits; null if a point has a coordinate
    that is null or not finite."""
    given = box is not None

    def measure(p: np.ndarray, sizes: np.ndarray, image: np.ndarray, own: np.ndarray | None) -> tuple[np.ndarray, ...]:
        p = np.where(np.abs(p) < 1e9, np.round(p, 6), p) + 0.0
        h, n = hulls(p, sizes)
        c, m = clip(h, n, image)
        clipped = areas(c, m)
        b = own if given else bounds(c, m)
        size = np.nan_to_num(np.maximum(b[:, 2] - b[:, 0], 0) * np.maximum(b[:, 3] - b[:, 1], 0))
        shared = areas(*clip(c, m, b)) if given else clipped
        either = clipped + size - shared
        with np.errstate(divide="ignore", invalid="ignore"):
            return areas(h, n), clipped, np.where(either == 0, np.nan, shared / either)

    @F.arrow_udf("area double, clipped double, iou double")
    def measured(points: pa.Array, width: pa.Array, height: pa.Array, x0: pa.Array, y0: pa.Array, x1: pa.Array, y1: pa.Array) -> pa.Array:
        w, h = _numbers(width), _numbers(height)
        image, own = np.stack([0 * w, 0 * h, w, h], 1), np.stack([_numbers(v) for v in (x0, y0, x1, y1)], 1)
        out = np.full((3, len(points)), np.nan)
        done = np.zeros(len(points), bool)
        for rows, p, sizes in _sets(points):
            out[:, rows], done[rows] = measure(p, sizes, image[rows], own[rows]), True
        return pa.StructArray.from_arrays([pa.array(v, mask=np.isnan(v)) for v in out], ["area", "clipped", "iou"], mask=pa.array(~done))

    value = lambda v: (v if isinstance(v, Column) else F.lit(float(v))).cast("double")
    return measured(points.cast(_POINTS), value(width), value(height), *(value(box[k] if given else 0.0) for k in ("x0", "y0", "x1", "y1")))
