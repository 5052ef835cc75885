"""Boxes given by eight corners in any order; the search for a box's axes is done in numpy for a batch of rows at once."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestat.functions.geometry import dot
from lodestat.functions.polygons import _POINTS, _coordinates, _let, _sets

#: A camera that is less than this share of the distances beyond the plane of a face lies in it: corners and camera come rounded.
IN_PLANE = 1e-9


def _minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def _length(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cross(a: Column, b: Column) -> Column:
    return F.array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def _axes(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(axes, worst) of boxes (rows, 8, 3) by box_axes; worst is nan where a point is the first one again."""
    rays = points[:, 1:] - points[:, :1]
    length = np.sqrt((rays * rays).sum(2))
    with np.errstate(divide="ignore", invalid="ignore"):
        unit = rays / length[:, :, None]
    cos = np.abs(np.einsum("nik,njk->nij", unit, unit))
    triples = np.array(list(combinations(range(7), 3)))
    i, j, k = triples.T
    each = np.maximum(np.maximum(cos[:, i, j], cos[:, i, k]), cos[:, j, k])
    best = each.argmin(1)
    axes = np.take_along_axis(unit, triples[best][:, :, None], 1)
    return axes, np.where((length > 1e-12).all(1), each[np.arange(len(each)), best], np.nan)


def box_axes(points: Column, tolerance: float = 1e-3) -> Column:
    """(axes, worst): the three directions from the first corner that are most nearly square to one another, and the largest absolute cosine
    among them; null unless there are eight points that differ from the first and worst is within the tolerance.

    Of the seven directions, those to the other ends of the three edges are the only ones square to one another."""

    @F.arrow_udf("axes array<array<double>>, worst double")
    def found(points: pa.Array) -> pa.Array:
        axes, worst = np.zeros((len(points), 3, 3)), np.full(len(points), np.nan)
        for rows, p, sizes in _sets(points, 3):
            eight = sizes == 8
            if eight.any():
                axes[rows[eight]], worst[rows[eight]] = _axes(p[eight, :8])
        three = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(0, a + 1, 3), pa.int32()), pa.array(axes.ravel()))
        each = pa.ListArray.from_arrays(pa.array(np.arange(0, 3 * len(axes) + 1, 3), pa.int32()), three(axes.size))
        return pa.StructArray.from_arrays([each, pa.array(worst)], ["axes", "worst"], mask=pa.array(~(worst <= tolerance)))

    return found(points.cast(_POINTS))


def visible_corners(points: Column, camera: Column, tolerance: float = 1e-3) -> Column:
    """For each corner of a box, in any order, whether one of the faces that have it is turned to the camera; null if it is no box or there
    is no camera. A face in whose plane the camera lies, but for rounding, is not turned to it.

    The faces are derived: along each axis, the four corners on either side of the centre."""

    @F.arrow_udf("array<boolean>")
    def shown(points: pa.Array, camera: pa.Array) -> pa.Array:
        eyes, out, done = _coordinates(camera, 3), np.zeros((len(points), 8), bool), np.zeros(len(points), bool)
        for rows, p, sizes in _sets(points, 3):
            fit = (sizes == 8) & np.isfinite(eyes[rows]).all(1)
            if not fit.any():
                continue
            rows, p = rows[fit], p[fit, :8]
            axes, worst = _axes(p)
            centre = p.mean(1)
            own, eye = p - centre[:, None], eyes[rows] - centre
            along, before = np.einsum("npk,nak->npa", own, axes), np.einsum("nk,nak->na", eye, axes)
            slack = IN_PLANE * (np.abs(p).max((1, 2)) + np.abs(eyes[rows]).max(1))[:, None]
            high, low = before > along.max(1) + slack, before < along.min(1) - slack
            out[rows] = ((high[:, None] & (along > 0)) | (low[:, None] & (along < 0))).any(2)
            done[rows] = worst <= tolerance
        offsets = pa.array(np.arange(0, out.size + 1, 8), pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(out.ravel()), mask=pa.array(~done))

    return shown(points.cast(_POINTS), camera.cast("array<double>"))


def frame_errors(points: Column, tolerance: float = 0.01, square: float = 0.2) -> Column:
    """(determinant, orthogonality, handedness, errors) of the frame that corners 1, 3 and 4 span from corner 0: columns are unit vectors
    along 0-1, 0-3 and 0-4. determinant of the frame, with orthogonality the largest absolute entry of R times its transpose less the unit
    matrix; handedness is the cosine between (0-1) x (0-3) and 0-4."""

    def frame(e: Column) -> Column:
        unit = lambda v: F.transform(v, lambda x: F.try_divide(x, _length(v)))
        r = F.array(*(unit(e[i]) for i in range(3)))

        def measure(m: Column) -> Column:
            entry = lambda i, j: m[0][i] * m[0][j] + m[1][i] * m[1][j] + m[2][i] * m[2][j] - (1.0 if i == j else 0.0)
            off = F.greatest(*(F.abs(entry(i, j)) for i in range(3) for j in range(i, 3)))
            normal = cross(m[0], m[1])
            det = dot(normal, m[2])
            hand = F.try_divide(det, _length(normal))
            errors = F.array_compact(F.array(F.when(F.coalesce(F.abs(det - 1) > tolerance, F.lit(True)), "DETERMINANT"), F.when(F.coalesce(off > tolerance, F.lit(True)), "ORTHOGONALITY"), F.when(F.coalesce(F.abs(hand) < 0.95, F.lit(True)), "FLAT")))
            return F.struct(det.alias("determinant"), off.alias("orthogonality"), hand.alias("handedness"), errors.alias("errors"))

        return _let(r, measure)

    return _let(F.array(*(_minus(points[i], points[0]) for i in (1, 3, 4))), frame)
