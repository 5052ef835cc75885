"""Geometry of small point sets as column expressions: a point is array<double>, a point set an array of points, matrices are flat and row by row.

Missing input gives null, never 0. Everything stays in native expressions, so no Python worker is needed.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, _sum(values) / F.size(values))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def move(points: Column, rotation: Column, shift: Column) -> Column:
    """R p + t for each point."""
    row = lambda p, i: dot(F.slice(rotation, 3 * i + 1, 3), p) + shift[i]
    return F.transform(points, lambda p: F.array(*(row(p, i) for i in range(3))))


def project(points: Column, k: Column, rotation: Column, shift: Column) -> Column:
    """Pixels of world points; null for a point that is not in front of the camera."""
    pixel = lambda c: F.array(k[0] * c[0] / c[2] + k[2], k[4] * c[1] / c[2] + k[5])
    return F.transform(move(points, rotation, shift), lambda c: F.when(c[2] > 0, pixel(c)))


def point_errors(a: Column, b: Column) -> Column:
    """Distances of the points that both sets have."""
    return F.filter(F.zip_with(a, b, distance), lambda e: e.isNotNull())


def mean_error(a: Column, b: Column) -> Column:
    return _mean(point_errors(a, b))


def max_error(a: Column, b: Column) -> Column:
    return F.array_max(point_errors(a, b))


def nearest_error(a: Column, b: Column) -> Column:
    """Mean distance from each point of a to the nearest of b, for symmetric objects."""
    return _mean(F.transform(a, lambda p: F.array_min(F.transform(b, lambda q: distance(p, q)))))


def diameter(points: Column) -> Column:
    return F.array_max(F.transform(points, lambda p: F.array_max(F.transform(points, lambda q: distance(p, q)))))


def rotation_error(r: Column, truth: Column) -> Column:
    """Angle between two rotations in degrees; the cosine is clipped."""
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (dot(r, truth) - 1) / 2))))


def view_angles(p: Column) -> Column:
    """azimuth (0 to 360), elevation and distance of a camera at p."""
    azimuth = F.pmod(F.degrees(F.atan2(p[1], p[0])), F.lit(360.0))
    return F.struct(azimuth.alias("azimuth"), F.degrees(F.atan2(p[2], F.hypot(p[0], p[1]))).alias("elevation"), F.sqrt(dot(p, p)).alias("distance"))


def inside(p: Column, width: int, height: int) -> Column:
    """True for pixels of the image; false, too, for a missing pixel."""
    return F.coalesce((p[0] >= 0) & (p[0] < width) & (p[1] >= 0) & (p[1] < height), F.lit(False))


def keypoint_states(pixels: Column, width: int, height: int) -> Column:
    """projectable and inside: numbers of points."""
    count = lambda f: F.size(F.filter(pixels, f))
    return F.struct(count(lambda p: p.isNotNull()).alias("projectable"), count(lambda p: inside(p, width, height)).alias("inside"))


def bbox(points: Column) -> Column:
    """left, top, right, bottom of the points that are there."""
    axis = lambda i: F.transform(F.filter(points, lambda p: p.isNotNull()), lambda p: p[i])
    return F.struct(F.array_min(axis(0)).alias("left"), F.array_min(axis(1)).alias("top"), F.array_max(axis(0)).alias("right"), F.array_max(axis(1)).alias("bottom"))


def bbox_iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes whose edges count as pixels."""
    area = lambda x: (x["right"] - x["left"] + 1) * (x["bottom"] - x["top"] + 1)
    side = lambda low, high: F.greatest(F.lit(0.0), F.least(a[high], b[high]) - F.greatest(a[low], b[low]) + 1)
    both = side("left", "right") * side("top", "bottom")
    return both / (area(a) + area(b) - both)


def bbox_gap(a: Column, b: Column) -> Column:
    """Distance between two boxes, 0 where they touch."""
    gap = lambda low, high: F.greatest(F.lit(0.0), b[low] - a[high], a[low] - b[high])
    return F.hypot(gap("left", "right"), gap("top", "bottom"))


def _turn(a: Column, b: Column, c: Column) -> Column:
    return F.signum((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))


def crossings(points: Column, segments: list[tuple[int, int]]) -> Column:
    """Number of pairs of segments, given by their points' positions, that cross properly."""
    at: Callable[[int], Column] = lambda i: points[i]
    out = F.lit(0)
    for n, (a, b) in enumerate(segments):
        for c, d in segments[n + 1 :]:
            cross = (_turn(at(a), at(b), at(c)) * _turn(at(a), at(b), at(d)) < 0) & (_turn(at(c), at(d), at(a)) * _turn(at(c), at(d), at(b)) < 0)
            out = out + cross.cast("int")
    return out


def keypoint_loss(self_visible: Column, within: Column, seen: Column) -> Column:
    """Points lost to the object itself, then to the image's edge, then to other objects; arrays of booleans."""
    flags = F.arrays_zip(self_visible.alias("own"), within.alias("within"), seen.alias("seen"))
    count = lambda f: F.size(F.filter(flags, f))
    return F.struct(
        count(lambda x: ~x["own"]).alias("lost_self"),
        count(lambda x: x["own"] & ~x["within"]).alias("lost_truncation"),
        count(lambda x: x["own"] & x["within"] & ~x["seen"]).alias("lost_occlusion"),
    )


def _length(p: Column) -> Column:
    return F.sqrt(dot(p, p))


def _minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


# three coordinates by themselves: arithmetic that is compiled, where functions with lambdas are interpreted for every row


def _minus3(a: list[Column], b: list[Column]) -> list[Column]:
    return [x - y for x, y in zip(a, b, strict=True)]


def _dot3(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _cross3(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def edge_ratios(points: Column, pairs: list[tuple[tuple[int, int], tuple[int, int]]]) -> Column:
    """Length of each first edge over its opposite one; null where that has no length."""
    return F.array(*(F.try_divide(distance(points[a], points[b]), distance(points[c], points[d])) for (a, b), (c, d) in pairs))


def corner_angles(points: Column, corners: list[tuple[int, int, int]]) -> Column:
    """Angle in degrees at the middle point of each triple."""

    def angle(a: int, b: int, c: int) -> Column:
        x, y = _minus(points[a], points[b]), _minus(points[c], points[b])
        cos = F.try_divide(dot(x, y), _length(x) * _length(y))
        return F.when(cos.isNotNull(), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))))

    return F.array(*(angle(*t) for t in corners))


def geometric_filter(detected: Column, reprojected: Column, width: Column, pairs: list, corners: list, min_points: int = 5, reproj_px: float = 5.0, ratio: tuple[float, float] = (0.5, 2.0), angle: tuple[float, float] = (60.0, 120.0), size: tuple[float, float] = (0.5, 2.5)) -> Column:
    """Whether a pseudo-label holds, and its three conditions: mean reprojection error, opposite edges and angles of the reprojected box, and width.
    Detected points that are missing or negative do not count."""
    valid = F.transform(detected, lambda p: F.when((p[0] >= 0) & (p[1] >= 0), p))
    n = F.size(F.filter(valid, lambda p: p.isNotNull()))
    error = mean_error(valid, reprojected)
    within = lambda values, lo, hi: F.forall(values, lambda x: F.coalesce((x >= lo) & (x <= hi), F.lit(False)))
    c1 = F.coalesce((n >= min_points) & (error < reproj_px), F.lit(False))
    c2 = F.coalesce((n >= min_points) & within(edge_ratios(reprojected, pairs), *ratio) & within(corner_angles(reprojected, corners), *angle), F.lit(False))
    c3 = F.coalesce((n >= min_points) & (width > size[0]) & (width < size[1]), F.lit(False))
    return F.struct((c1 & c2 & c3).alias("is_valid"), c1.alias("c_reproj"), c2.alias("c_geometry"), c3.alias("c_size"), error.alias("reproj_error"))


def edge_cv(points: Column, edges: list[tuple[int, int]]) -> Column:
    """Standard deviation of the edges' lengths over their mean."""
    lengths = F.array(*(distance(points[a], points[b]) for a, b in edges))
    mean = _mean(lengths)
    return F.try_divide(F.sqrt(_mean(F.transform(lengths, lambda x: (x - mean) * (x - mean)))), mean)


def edge_ratio_check(points: Column, first: list[tuple[int, int]], second: list[tuple[int, int]], wanted: float, tolerance: float) -> Column:
    """(ratio, ok): mean length of the first edges over that of the second, and whether it lies within a share of what is wanted; ok is false
    where an edge's end is unknown or the second edges have no length."""
    length = lambda edges: _mean(F.array(*(distance(points[a], points[b]) for a, b in edges)))
    ratio = F.try_divide(length(first), length(second))
    return F.struct(ratio.alias("ratio"), F.coalesce(F.abs(ratio / wanted - 1) <= tolerance, F.lit(False)).alias("ok"))


def flip_consistency(points: Column, flipped: Column, order: list[int], width: float) -> Column:
    """Mean distance between points and those found in the mirrored image, mirrored back and put in order."""
    back = F.array(*(F.array(F.lit(float(width)) - flipped[i][0], flipped[i][1]) for i in order))
    return mean_error(points, back)


def verify_cuboid(points: Column, axes: tuple[int, int, int, int] = (0, 1, 3, 4), edges: tuple = (((0, 1), (3, 2), (4, 5), (7, 6)), ((0, 3), (1, 2), (4, 7), (5, 6)), ((0, 4), (1, 5), (2, 6), (3, 7))), degrees: float = 3.0, share: float = 0.03, hand: float = 0.95) -> Column:
    """Errors of eight labelled corners: edges at corner axes[0] that are not square within `degrees`, parallel edges whose lengths differ by more than
    `share`, and axes that are not right-handed."""
    at = [[points[i][k].cast("double") for k in range(3)] for i in range(8)]
    x, y, z = (_minus3(at[i], at[axes[0]]) for i in axes[1:])
    size = {id(v): F.sqrt(_dot3(v, v)) for v in (x, y, z)}
    cosine = lambda a, b: _dot3(a, b) / (size[id(a)] * size[id(b)])
    square = lambda a, b: F.abs(cosine(a, b)) > F.lit(math.sin(math.radians(degrees)))
    skew = square(x, y) | square(y, z) | square(x, z)
    uneven = F.lit(False)
    for group in edges:
        lengths = [F.sqrt(_dot3(d, d)) for d in (_minus3(at[a], at[b]) for a, b in group)]
        uneven = uneven | (F.greatest(*lengths) > (1 + share) * F.least(*lengths))
    rhr = _dot3(_cross3(x, y), z) / (size[id(x)] * size[id(y)] * size[id(z)])
    said = lambda when, name: F.when(when, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    return F.concat(said(skew, "not_square"), said(uneven, "uneven_edges"), said(F.abs(rhr) < hand, "flat_axes"), said(rhr < 0, "left_handed"))


def front_is_near(points: Column, faces: dict[str, tuple[int, int, int, int]], camera: Column, tie: float = 0.05) -> Column:
    """Name of the face whose centre is nearest to the camera; the first of those within tie of it."""
    centre = lambda f: F.array(*(sum((points[i][a] for i in f[1:]), points[f[0]][a]) / len(f) for a in range(3)))
    each = {k: distance(centre(f), camera) for k, f in faces.items()}
    least = F.least(*each.values())
    return F.coalesce(*(F.when(d <= least + tie, F.lit(k)) for k, d in each.items()))


def self_visible(points: Column, faces: list[tuple[int, int, int, int]], camera: Column) -> Column:
    """For each corner, whether a face that has it is turned to the camera. Corners of a face run so that the normal points outwards."""
    at = [[points[i][k] for k in range(3)] for i in range(8)]
    eye = [camera[k] for k in range(3)]
    shown = [_dot3(_cross3(_minus3(at[f[1]], at[f[0]]), _minus3(at[f[3]], at[f[0]])), _minus3(eye, at[f[0]])) > 0 for f in faces]
    return F.array(*(reduce(lambda a, b: a | b, [s for s, f in zip(shown, faces, strict=True) if i in f], F.lit(False)) for i in range(8)))
