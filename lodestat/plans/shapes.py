"""Queries on hulls and on boxes whose corners come in any order."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestat.functions import cuboids as B
from lodestat.functions import polygons as P
from lodestat.plans.registry import query, rounded

# an image of 60 x 80 and, for each part, a rhombus around a point that may lie near its edge, with further points inside it


@query("""WITH r AS (SELECT p_partkey, (p_partkey % 60)::DOUBLE AS cx, (p_retailprice - floor(p_retailprice / 80) * 80)::DOUBLE AS cy, p_size::DOUBLE AS s FROM part),
c AS (SELECT *, greatest(cx - s, 0) AS x0, least(cx + s, 60) AS x1 FROM r),
steps AS (SELECT p_partkey, cx, cy, s, x0, x1, unnest(list_distinct(list_filter([x0, x1, cx, cx - s + cy, cx + s - cy, cx - s + (80 - cy), cx + s - (80 - cy), cx - cy + s, cx + cy - s], lambda v: v >= x0 AND v <= x1))) AS x FROM c),
h AS (SELECT p_partkey, s, x, least(cy + (s - abs(x - cx)), 80) - greatest(cy - (s - abs(x - cx)), 0) AS h FROM steps),
a AS (SELECT p_partkey, s, (x - lag(x) OVER w) * (h + lag(h) OVER w) / 2 AS part FROM h WINDOW w AS (PARTITION BY p_partkey ORDER BY x))
SELECT p_partkey, round(2 * any_value(s) * any_value(s), 4) AS area, round(coalesce(sum(part), 0), 4) AS clipped FROM a GROUP BY 1""")
def q13_02_clipped_hull(t):
    """The clipped area is that of the slices between the places where the rhombus or its cut changes direction."""
    s, cx = F.col("p_size").cast("double"), (F.col("p_partkey") % 60).cast("double")
    cy = F.col("p_retailprice") - F.floor(F.col("p_retailprice") / 80) * 80
    at = lambda x, y: F.array(cx + s * x, cy + s * y)
    points = F.array(*(at(x, y) for x, y in ((0.0, 0.0), (1.0, 0.0), (0.25, 0.5), (0.0, 1.0), (-0.5, -0.5), (-1.0, 0.0), (0.0, -1.0), (1.0, 0.0))))
    return rounded(t("part").select("p_partkey", P.hull_in_image(points, 60.0, 80.0).alias("h")).select("p_partkey", "h.area", "h.clipped"), 4)


@query("SELECT p_partkey, round(p_size * (p_size + 20.0::DOUBLE) * w / (p_size * (p_size + 20.0::DOUBLE) + 900 - p_size * (p_size + 20.0::DOUBLE) * w), 6) AS iou FROM (SELECT *, least(p_size, 30.0::DOUBLE) * least(p_size + 20, 30.0::DOUBLE) / (p_size * (p_size + 20.0::DOUBLE)) AS w FROM part)")
def q13_02_hull_iou(t):
    """A rectangle at the image's corner and a box of 30 x 30 there."""
    s = F.col("p_size").cast("double")
    points = F.array(*(F.array(s * x, (s + 20) * y) for x, y in ((0.0, 0.0), (0.5, 0.25), (1.0, 1.0), (1.0, 0.0), (0.0, 1.0))))
    box = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(30.0).alias("x1"), F.lit(30.0).alias("y1"))
    return rounded(t("part").select("p_partkey", P.hull_in_image(points, 1000.0, 1000.0, box).alias("h")).select("p_partkey", "h.iou"))


# boxes of size (a, b, c), turned about an axis, corners in an order that depends on the part

CORNERS = [(x, y, z) for x in (0, 1) for y in (0, 1) for z in (0, 1)]
_SHOWN = " OR ".join(f"(({2 * c - 1}) * ({v}) > {e} / 2.0::DOUBLE AND {k} = {c})" for v, e, k in (("ex", "a", "x"), ("ey", "b", "y"), ("ez", "d", "z")) for c in (0, 1))
_BOX = "SELECT p_partkey, p_size + 1.0::DOUBLE AS a, p_size * 2 + 1.0::DOUBLE AS b, 4.0::DOUBLE AS d, (p_retailprice - 1000) / 10 AS ex, (p_partkey % 100) - 50.0::DOUBLE AS ey, (p_partkey % 7) * 1.0::DOUBLE AS ez FROM part"


def _turned(t):
    """points in one of eight orders, and the camera; ex, ey, ez is the camera as the box sees it."""
    a, b, d = F.col("p_size") + 1.0, F.col("p_size") * 2 + 1.0, F.lit(4.0)
    angle = F.col("p_partkey") * 0.1
    ex, ey, ez = (F.col("p_retailprice") - 1000) / 10, (F.col("p_partkey") % 100) - F.lit(50.0), (F.col("p_partkey") % 7) * F.lit(1.0)
    turn = lambda x, y, z: F.array(F.cos(angle) * x - F.sin(angle) * y + 5.0, F.sin(angle) * x + F.cos(angle) * y - 3.0, z + 2.0)
    corners = F.array(*(turn((x - 0.5) * a, (y - 0.5) * b, (z - 0.5) * d) for x, y, z in CORNERS))
    order = F.array_sort(F.transform(corners, lambda p, i: F.struct(((i * 5 + F.col("p_partkey") % 8) % 8).alias("o"), i.alias("i"), p.alias("p"))))
    return t("part").select("p_partkey", order.alias("own"), turn(ex, ey, ez).alias("camera")).withColumn("points", F.transform("own", lambda s: s["p"]))


@query(f"WITH b AS ({_BOX}), c AS (SELECT b.*, x, y, z FROM b, range(0, 2) i(x), range(0, 2) j(y), range(0, 2) k(z)) SELECT p_partkey, x * 4 + y * 2 + z AS corner, {_SHOWN} AS visible FROM c")
def q11_10_any_order(t):
    each = _turned(t).select("p_partkey", F.posexplode(F.arrays_zip("own", B.visible_corners(F.col("points"), F.col("camera")).alias("seen"))).alias("j", "x"))
    return each.select("p_partkey", F.col("x.own.i").cast("bigint").alias("corner"), F.col("x.seen").alias("visible"))


@query("SELECT p_partkey, round(l * r, 6) AS determinant, round(greatest(abs(r * r - 1), abs(s * s * l * l), abs(s * r)), 4) AS orthogonality, concat_ws('|', CASE WHEN abs(l * r - 1) > 0.01 THEN 'DETERMINANT' END, CASE WHEN abs(s) > 0.01 THEN 'ORTHOGONALITY' END) AS errors FROM (SELECT *, 1 / sqrt(1 + k * k) AS r, k / sqrt(1 + k * k) AS s FROM (SELECT p_partkey, CASE WHEN p_brand = 'Brand#11' THEN 0.2::DOUBLE ELSE 0 END AS k, CASE WHEN p_retailprice > 1200 THEN -1.0::DOUBLE ELSE 1.0 END AS l FROM part))".replace("greatest(abs(r * r - 1), abs(s * s * l * l), abs(s * r))", "greatest(abs(s * s), abs(s * r))"))
def q11_07_frame(t):
    """Boxes whose third edge leans or points the other way."""
    from lodestat.plans.evaluation import _cuboid

    f = t("part").select("p_partkey", B.frame_errors(F.transform(_cuboid(), lambda p: p)).alias("f"))
    return rounded(f.select("p_partkey", F.round("f.determinant", 6).alias("determinant"), F.round("f.orthogonality", 4).alias("orthogonality"), F.array_join("f.errors", "|").alias("errors")))
