"""Queries on many-axis candidates and nested records."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestat.operators import nested as N
from lodestat.operators import skyline as K
from lodestat.plans.registry import query, stream_query

# candidates: lines of a supplier, with one flag and four margins, some of them unknown

_CANDIDATES = """WITH v AS (
  SELECT l_suppkey AS s, l_partkey AS geometry, l_orderkey AS o, l_linenumber AS n, l_linestatus = 'F' AS hard, CASE WHEN l_tax = 0.08 THEN NULL ELSE l_returnflag = 'N' END AS side,
    CASE WHEN l_discount = 0 THEN NULL ELSE l_quantity - 40 END AS visibility, round(0.02 - l_tax, 6) AS target, round(30000 - l_extendedprice, 2) AS g1, round(0.05 - l_discount, 6) AS g2,
    CASE WHEN l_tax <> 0.01 THEN l_extendedprice END AS score, l_extendedprice AS price, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS r
  FROM lineitem
), c AS (
  SELECT *, least(visibility, 0) AS cv, least(target, 0) AS ct, least(g1, 0) AS c1, least(g2, 0) AS c2,
    CASE WHEN side IS NULL OR visibility IS NULL THEN NULL ELSE list_filter([CASE WHEN NOT side THEN 'side' END, CASE WHEN visibility < 0 THEN 'visibility' END, CASE WHEN target < 0 THEN 'target' END, CASE WHEN g1 < 0 THEN 'G1' END, CASE WHEN g2 < 0 THEN 'G2' END], lambda x: x IS NOT NULL) END AS violated
  FROM v WHERE r = 1 AND hard
), k AS (
  SELECT * FROM c WHERE side IS NULL OR visibility IS NULL OR NOT EXISTS (
    SELECT 1 FROM c d WHERE d.s = c.s AND d.side IS NOT NULL AND d.visibility IS NOT NULL AND d.side >= c.side AND d.cv >= c.cv AND d.ct >= c.ct AND d.c1 >= c.c1 AND d.c2 >= c.c2
      AND (d.side > c.side OR d.cv > c.cv OR d.ct > c.ct OR d.c1 > c.c1 OR d.c2 > c.c2))
) """


def _skyline(t):
    v = t("lineitem").select(
        F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("geometry"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), (F.col("l_linestatus") == "F").alias("hard"),
        F.when(F.col("l_tax") != 0.08, F.col("l_returnflag") == "N").alias("side"), F.when(F.col("l_discount") != 0, F.col("l_quantity") - 40).alias("visibility"),
        F.round(0.02 - F.col("l_tax"), 6).alias("target"), F.round(30000 - F.col("l_extendedprice"), 2).alias("g1"), F.round(0.05 - F.col("l_discount"), 6).alias("g2"),
        F.when(F.col("l_tax") != 0.01, F.col("l_extendedprice")).alias("score"), F.col("l_extendedprice").alias("price"),
    )
    rest = [c for c in v.columns if c not in ("s", "geometry")]
    first = v.groupBy("s", "geometry").agg(F.min_by(F.struct(*rest), F.struct("o", "n", "price")).alias("x")).select("s", "geometry", "x.*")
    return K.skyline(first, ["s"], ["side"], ["visibility", "target", "g1", "g2"], F.col("hard"))


@query(_CANDIDATES + "SELECT s, geometry, o, n FROM k")
def q6_06_skyline(t):
    """Five axes, unknown ones kept."""
    return _skyline(t).select("s", "geometry", "o", "n")


@query(
    _CANDIDATES
    + """, ranked AS (
  SELECT *, coalesce(len(violated), 1048576) AS v, -coalesce(list_min(list_filter([cv, ct, c1, c2], lambda x: x IS NOT NULL)), -99) AS b, -coalesce(score, -99) AS e FROM k
), roles AS (
  SELECT s, 1 AS i, 'global_best' AS role, geometry, o, row_number() OVER (PARTITION BY s ORDER BY score IS NULL, v, b, e, n, CAST(o AS VARCHAR)) AS r FROM ranked
  UNION ALL SELECT s, 2, 'side_champion', geometry, o, row_number() OVER (PARTITION BY s ORDER BY len(violated) > 1, v, b, e, n, CAST(o AS VARCHAR)) FROM ranked WHERE list_contains(violated, 'side')
  UNION ALL SELECT s, 3, 'G1_champion', geometry, o, row_number() OVER (PARTITION BY s ORDER BY len(violated) > 1, v, b, e, n, CAST(o AS VARCHAR)) FROM ranked WHERE list_contains(violated, 'G1')
), once AS (SELECT *, row_number() OVER (PARTITION BY s, geometry ORDER BY i) AS again FROM roles WHERE r = 1)
SELECT s, CAST(row_number() OVER (PARTITION BY s ORDER BY i) - 1 AS INTEGER) AS place, role, geometry, o FROM once WHERE again = 1 QUALIFY place < 3"""
)
def q6_07_beam(t):
    c = _skyline(t)
    names = {"side": ~F.col("side"), "visibility": F.col("visibility") < 0, "target": F.col("target") < 0, "G1": F.col("g1") < 0, "G2": F.col("g2") < 0}
    violated = F.when(F.col("side").isNotNull() & F.col("visibility").isNotNull(), F.array_compact(F.array(*(F.when(x, k) for k, x in names.items()))))
    c = c.withColumn("violated", violated)
    return K.beam(c, ["s"], "geometry", "n", "score", "violated", ["visibility", "target", "g1", "g2"], "o", ["side", "G1"]).select("s", "place", "role", "geometry", "o")


# nested records: an order with its lines, and a second run of it

_PAIRS = """WITH l AS (
  SELECT l_orderkey AS o, l_quantity AS q, l_tax AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_tax) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem
), d AS (
  SELECT o_orderkey AS o, '$.lines' AS path, 'length' AS what, 0 AS i, 0 AS f FROM orders WHERE o_totalprice > 400000 AND o_orderkey IN (SELECT o FROM l)
  UNION ALL SELECT o, '$.lines[' || i || '].qty', 'value', i, 1 FROM l JOIN orders ON o = o_orderkey WHERE x = 0.08 AND o_totalprice <= 400000
  UNION ALL SELECT o, '$.lines[' || i || '].tags', 'keys', i, 2 FROM l JOIN orders ON o = o_orderkey WHERE q = 50 AND o_totalprice <= 400000
  UNION ALL SELECT o_orderkey, '$.meta.priority', 'value', 1000000, 3 FROM orders WHERE o_orderpriority = '1-URGENT'
) """


def _records(t):
    """Two runs of the same orders; run_id always differs and is volatile."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_tax")
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(line)).alias("raw"))
    o = t("orders").join(lines, "o_orderkey", "left").withColumn("raw", F.coalesce("raw", F.array().cast(lines.schema["raw"].dataType)))

    def make(second: bool):
        price = F.col("o_totalprice")
        raw = F.when(price > 400000, F.slice("raw", 1, F.greatest(F.size("raw") - 1, F.lit(0)))).otherwise(F.col("raw")) if second else F.col("raw")
        qty = lambda x: F.when(x["l_tax"] == 0.08, x["l_quantity"] + 1).otherwise(x["l_quantity"]) if second else x["l_quantity"]
        tags = lambda x: F.map_concat(F.create_map(F.lit("part"), x["l_partkey"], F.lit("run_id"), F.lit(int(second)).cast("bigint")), F.when(x["l_quantity"] == 50, F.create_map(F.lit("z"), F.lit(1).cast("bigint"))).otherwise(F.create_map().cast("map<string,bigint>")) if second else F.create_map().cast("map<string,bigint>"))
        built = F.transform(raw, lambda x: F.struct(x["l_linenumber"].alias("n"), qty(x).alias("qty"), tags(x).alias("tags")))
        priority = F.when(F.col("o_orderpriority") == "1-URGENT", "X").otherwise(F.col("o_orderpriority")) if second else F.col("o_orderpriority")
        rows = o.where("o_orderstatus <> 'P' or o_custkey < 500") if second else o.where("o_orderstatus <> 'O' or o_custkey < 500")
        return rows.select("o_orderkey", F.struct(priority.alias("priority"), F.lit(int(second)).alias("run_id"), "o_orderdate").alias("meta"), built.alias("lines"))

    return make(False), make(True)


def _diff(t):
    return N.record_diff(*_records(t), "o_orderkey", ["run_id"])


@query(_PAIRS + "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_custkey >= 500 THEN 'left_only' WHEN o_orderstatus = 'O' AND o_custkey >= 500 THEN 'right_only' WHEN o_orderkey IN (SELECT o FROM d) THEN 'differs' ELSE 'equal' END AS state FROM orders")
def q7_01_nested_diff(t):
    return _diff(t).select("o_orderkey", "state")


_BOTH = "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR o_custkey < 500"


@query(_PAIRS + f"SELECT o AS o_orderkey, path, what FROM (SELECT *, row_number() OVER (PARTITION BY o ORDER BY i, f) AS r FROM d) WHERE r = 1 AND o IN ({_BOTH})")
def q7_02_nested_path(t):
    return N.first_paths(_diff(t), "o_orderkey").select("o_orderkey", "path", "what")


@query(_PAIRS + f"SELECT regexp_replace(path, '[0-9]+', '') AS path, what, count(*) AS n, count(DISTINCT o) AS n_rows FROM d WHERE o IN ({_BOTH}) GROUP BY 1, 2")
def q7_03_nested_matrix(t):
    return N.mismatch_matrix(_diff(t), "o_orderkey")


@query(
    "SELECT event_id, CASE WHEN value > 95 THEN '$' WHEN event_type = 'click' AND value > 50 THEN '$.log.k' WHEN user_id < 20 THEN '$.log.steps' WHEN user_id < 60 THEN '$.log.steps[1].t' ELSE '$.note' END AS path, "
    "CASE WHEN value > 95 THEN 'keys' WHEN event_type = 'click' AND value > 50 THEN 'type' WHEN user_id < 20 THEN 'length' ELSE 'value' END AS what FROM events WHERE value IS NOT NULL AND (value > 95 OR (event_type = 'click' AND value > 50) OR user_id < 60 OR event_type = 'error')"
)
def q7_02_json_path(t):
    """JSON texts of two runs, compared without a schema."""
    e = t("events").where("value is not null")

    def make(second: bool):
        steps = lambda x: F.when(F.col("user_id") < 20, f'[{{"t": 1}}{x}]').otherwise(F.format_string('[{"t": 1}, {"t": %d}]', F.when(F.col("user_id") < 60, 2 + int(second)).otherwise(2)))
        kind = F.when((F.col("event_type") == "click") & (F.col("value") > 50), '"x"' if second else "7").otherwise(F.lit("7"))
        more = F.when(F.col("value") > 95, ', "more": null').otherwise("") if second else F.lit("")
        note = F.when(F.col("event_type") == "error", '"b"' if second else '"a"').otherwise(F.lit('"c"'))
        text = F.concat(F.lit('{"log": {"k": '), kind, F.lit(', "steps": '), steps(', {"t": 9}' if second else ""), F.lit('}, "note": '), note, F.lit(f', "run_id": {int(second)}'), more, F.lit("}"))
        return e.select("event_id", text.alias("json"))

    return N.json_diff(make(False), make(True), "event_id", "json", ["run_id"]).select("event_id", "path", "what")
