"""Queries on point sets. Eight points come from the first 24 numbers of an embedding."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestat.functions import geometry as G
from lodestat.plans.registry import query, rounded

WIDTH, HEIGHT = 640, 480
_P = "WITH p AS (SELECT vec_id, i, embedding[3 * i + 1]::DOUBLE AS x, embedding[3 * i + 2]::DOUBLE AS y, embedding[3 * i + 3]::DOUBLE AS z FROM embeddings, range(0, 8) r(i)), "
_UV = _P + "c AS (SELECT vec_id, i, -y + 0.1 AS x, x + 0.2 AS y, z + d AS z, d FROM p, (VALUES (0.05::DOUBLE), (0.1)) s(d)), uv AS (SELECT vec_id, i, d, CASE WHEN z > 0 THEN 600 * x / z + 320 END AS u, CASE WHEN z > 0 THEN 600 * y / z + 240 END AS v FROM c) "


def _points():
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.transform(F.slice("embedding", 3 * i + 1, 3), lambda x: x.cast("double")))


def _numbers(*x: float):
    return F.array(*(F.lit(float(v)) for v in x))


def _pixels(depth: float):
    """The camera is turned by a right angle about its axis."""
    return G.project(_points(), _numbers(600, 0, 320, 0, 600, 240, 0, 0, 1), _numbers(0, -1, 0, 1, 0, 0, 0, 0, 1), _numbers(0.1, 0.2, depth))


@query(_UV + "SELECT vec_id, round(avg(e), 4) AS mean_px, round(max(e), 4) AS max_px FROM (SELECT a.vec_id, sqrt((a.u - b.u) ** 2 + (a.v - b.v) ** 2) AS e FROM uv a JOIN uv b ON a.vec_id = b.vec_id AND a.i = b.i WHERE a.d = 0.05 AND b.d = 0.1) GROUP BY 1")
def q11_01_reprojection_error(t):
    both = t("embeddings").select("vec_id", _pixels(0.05).alias("a"), _pixels(0.1).alias("b"))
    return rounded(both.select("vec_id", G.mean_error(F.col("a"), F.col("b")).alias("mean_px"), G.max_error(F.col("a"), F.col("b")).alias("max_px")), 4)


@query(_UV + f"SELECT vec_id, count(u) AS projectable, count(*) FILTER (u >= 0 AND u < {WIDTH} AND v >= 0 AND v < {HEIGHT}) AS inside FROM uv WHERE d = 0.1 GROUP BY 1")
def q11_02_keypoint_states(t):
    return t("embeddings").select("vec_id", G.keypoint_states(_pixels(0.1), WIDTH, HEIGHT).alias("s")).select("vec_id", "s.*")


@query(
    _P + "q AS (SELECT vec_id, i, x + 0.02 * i AS x, y, z - 0.01 FROM p), d AS (SELECT a.vec_id, a.i, b.i AS j, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.c) ** 2) AS e FROM p a JOIN q b(vec_id, i, x, y, c) USING (vec_id)), "
    "s AS (SELECT vec_id, max(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)) AS diameter FROM p a JOIN p b USING (vec_id) GROUP BY 1) "
    "SELECT vec_id, round(m, 6) AS add_m, round(n, 6) AS adds_m, round(diameter, 6) AS diameter, m < 0.1 * diameter AS correct FROM (SELECT vec_id, avg(e) AS m FROM d WHERE i = j GROUP BY 1) JOIN (SELECT vec_id, avg(e) AS n FROM (SELECT vec_id, i, min(e) AS e FROM d GROUP BY 1, 2) GROUP BY 1) USING (vec_id) JOIN s USING (vec_id)"
)
def q11_03_model_distance(t):
    shifted = F.transform("a", lambda p, i: F.array(p[0] + 0.02 * i, p[1], p[2] - 0.01))
    both = t("embeddings").select("vec_id", _points().alias("a")).withColumn("b", shifted)
    a, b = F.col("a"), F.col("b")
    out = both.select("vec_id", G.mean_error(a, b).alias("add_m"), G.nearest_error(a, b).alias("adds_m"), G.diameter(a).alias("diameter"))
    return rounded(out.withColumn("correct", F.col("add_m") < 0.1 * F.col("diameter")))


@query("SELECT o_orderkey, round(least(d, 360 - d)::DOUBLE, 3) AS rotation_deg, least(d, 360 - d) < 5 AS correct FROM (SELECT o_orderkey, abs(o_orderkey % 360 - o_custkey % 360) AS d FROM orders)")
def q11_04_pose_error(t):
    def turned(key):
        angle = F.radians(F.pmod(F.col(key), F.lit(360)).cast("double"))
        return F.array(F.cos(angle), -F.sin(angle), F.lit(0.0), F.sin(angle), F.cos(angle), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))

    return rounded(t("orders").select("o_orderkey", G.rotation_error(turned("o_orderkey"), turned("o_custkey")).alias("rotation_deg")).withColumn("correct", F.col("rotation_deg") < 5 - 1e-6), 3)


@query("SELECT vec_id, round(CASE WHEN a < 0 THEN a + 360 ELSE a END, 6) AS azimuth, round(degrees(atan2(z, sqrt(x * x + y * y))), 6) AS elevation, round(sqrt(x * x + y * y + z * z), 6) AS distance FROM (SELECT *, degrees(atan2(y, x)) AS a FROM (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings))")
def q11_08_view_angles(t):
    return rounded(t("embeddings").select("vec_id", G.view_angles(_points()[0]).alias("a")).select("vec_id", "a.*"))


@query("SELECT vec_id, count(*) FILTER (x <= 0) AS lost_self, count(*) FILTER (x > 0 AND y <= 0) AS lost_truncation, count(*) FILTER (x > 0 AND y > 0 AND z <= 0) AS lost_occlusion FROM (" + _P + "_ AS (SELECT 1) SELECT * FROM p) GROUP BY 1")
def q11_11_keypoint_loss(t):
    positive = lambda axis: F.transform(_points(), lambda p: p[axis] > 0)
    own, within, seen = (positive(axis) for axis in range(3))
    return t("embeddings").select("vec_id", G.keypoint_loss(own, within, seen).alias("x")).select("vec_id", "x.*")


@query(
    _P + "b AS (SELECT vec_id, i < 4 AS f, min(x) * 100 AS l, min(y) * 100 AS t, max(x) * 100 AS r, max(y) * 100 AS o FROM p GROUP BY 1, 2), m AS (SELECT a.vec_id, a.r - a.l AS width, a.o - a.t AS height, (a.r - a.l + 1) * (a.o - a.t + 1) + (b.r - b.l + 1) * (b.o - b.t + 1) AS both_areas, "
    "greatest(0, least(a.r, b.r) - greatest(a.l, b.l) + 1) * greatest(0, least(a.o, b.o) - greatest(a.t, b.t) + 1) AS common, sqrt(greatest(0, b.l - a.r, a.l - b.r) ** 2 + greatest(0, b.t - a.o, a.t - b.o) ** 2) AS gap FROM b a JOIN b ON a.vec_id = b.vec_id AND a.f AND NOT b.f) "
    "SELECT vec_id, round(width, 6) AS width, round(height, 6) AS height, round(common / (both_areas - common), 6) AS iou, round(gap, 6) AS gap FROM m"
)
def q11_12_box_measures(t):
    half = lambda start: G.bbox(F.transform(F.slice(_points(), start, 4), lambda p: F.transform(p, lambda x: x * 100)))
    boxes = t("embeddings").select("vec_id", half(1).alias("a"), half(5).alias("b"))
    a, b = F.col("a"), F.col("b")
    return rounded(boxes.select("vec_id", (a["right"] - a["left"]).alias("width"), (a["bottom"] - a["top"]).alias("height"), G.bbox_iou(a, b).alias("iou"), G.bbox_gap(a, b).alias("gap")))


@query(
    _P + "s AS (SELECT a.vec_id, a.i, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS byy FROM p a JOIN p b ON a.vec_id = b.vec_id AND b.i = a.i + 4), k AS (SELECT s.vec_id, sign((bx - ax) * (cy - ay) - (byy - ay) * (cx - ax)) * sign((bx - ax) * (dy - ay) - (byy - ay) * (dx - ax)) AS m, sign((dx - cx) * (ay - cy) - (dy - cy) * (ax - cx)) * sign((dx - cx) * (byy - cy) - (dy - cy) * (bx - cx)) AS n "
    "FROM s JOIN (SELECT vec_id, i AS j, ax AS cx, ay AS cy, bx AS dx, byy AS dy FROM s) u ON s.vec_id = u.vec_id AND s.i < u.j) SELECT vec_id, count(*) FILTER (m < 0 AND n < 0) AS crossings FROM k GROUP BY 1"
)
def q11_13_connector_crossings(t):
    return t("embeddings").select("vec_id", _points().alias("p")).select("vec_id", G.crossings(F.col("p"), [(i, i + 4) for i in range(4)]).alias("crossings"))


@query(_UV + f"SELECT vec_id, round((max(u) - min(u)) / {WIDTH}, 4) AS size_ratio FROM uv WHERE d = 0.1 GROUP BY 1")
def q11_14_projected_size(t):
    box = t("embeddings").select("vec_id", G.bbox(_pixels(0.1)).alias("b"))
    return rounded(box.select("vec_id", ((F.col("b.right") - F.col("b.left")) / WIDTH).alias("size_ratio")), 4)


@query("SELECT l_returnflag, count(*) AS n, count(e) AS n_known, round(avg(e), 6) AS mean_error FROM (SELECT l_returnflag, abs(l_discount - nullif(l_tax, 0)) AS e FROM lineitem) GROUP BY 1")
def q11_16_occlusion_error(t):
    error = F.abs(F.col("l_discount") - F.nullif(F.col("l_tax"), F.lit(0.0)))
    return rounded(t("lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count(error).alias("n_known"), F.avg(error).alias("mean_error")))
