
from __future__ import annotations

from pyspark.sql import functions as F

from lodestat.operators import cases as C
from lodestat.plans.registry import query

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM"]


@query("SELECT o_orderkey AS id, coalesce(c_acctbal, o_totalprice) AS amount, coalesce(CASE WHEN trim(c_mktsegment) <> '' THEN c_mktsegment END, o_orderpriority) AS label FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def q2_02_project_sources(t):
    rich = t("customer").where("c_acctbal > 0")
    j = t("orders").join(rich, F.col("o_custkey") == F.col("c_custkey"), "left")
    nested = j.select(F.struct("o_orderkey", "o_totalprice", "o_orderpriority").alias("o"), F.struct("c_acctbal", "c_mktsegment").alias("c"))
    return C.project_sources(nested, {"id": [("o", "o_orderkey")], "amount": [("c", "absent"), ("c", "c_acctbal"), ("o", "o_totalprice")], "label": [("c", "c_mktsegment"), ("o", "o_orderpriority")]})


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'accepted' ELSE 'rejected' END AS verdict, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS has_plan FROM orders WHERE o_orderstatus IN ('F', 'O')")
def q3_05_case_lock(t):
    o, plans = t("orders"), t("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return C.lock_cases(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), plans, "o_orderkey")


@query("SELECT c_custkey, count(o_orderkey) AS attempts, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS best_item, max(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT') AS run_1, max(o_totalprice) FILTER (WHERE o_orderpriority = '2-HIGH') AS run_2, max(o_totalprice) FILTER (WHERE o_orderpriority = '3-MEDIUM') AS run_3 FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def q3_06_failure_atlas(t):
    runs = t("orders").withColumnRenamed("o_custkey", "c_custkey")
    return C.failure_atlas(t("customer"), runs, "c_custkey", "o_orderpriority", PRIORITIES, "o_totalprice", "o_orderkey")


@query("SELECT l_suppkey, count(*) FILTER (WHERE r <= 20) AS free, count(*) FILTER (WHERE r > 20) AS paid FROM (SELECT l_suppkey, dense_rank() OVER (PARTITION BY l_suppkey ORDER BY f) AS r FROM (SELECT l_suppkey, min(l_orderkey * 10 + l_linenumber) OVER (PARTITION BY l_suppkey, l_partkey) AS f FROM lineitem)) GROUP BY 1")
def q5_06_budget_usage(t):
    log = t("lineitem").withColumn("seq", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return C.budget_usage(log, "l_suppkey", "seq", "l_partkey", 20)


@query("SELECT l_orderkey, l_partkey, CASE WHEN bool_or(l_returnflag = 'R') AND bool_or(l_quantity > 25) THEN 'allowed' WHEN bool_or(l_returnflag = 'R') THEN 'unexpected' ELSE 'missing' END AS status FROM lineitem WHERE l_returnflag = 'R' OR l_quantity > 25 GROUP BY 1, 2")
def q8_08_additions(t):
    li = t("lineitem")
    return C.check_additions(li.where("l_returnflag = 'R'"), li.where("l_quantity > 25"), ["l_orderkey", "l_partkey"])


@query(r"WITH e AS (SELECT page_id, regexp_extract(url, '://[^/]*/?(.*)$', 1) AS path FROM pages), f AS (SELECT page_id, path, min(page_id) OVER (PARTITION BY path) AS f FROM e WHERE trim(path) <> ''), k AS (SELECT path FROM e GROUP BY 1 HAVING count(*) > 1) SELECT page_id, code FROM (SELECT page_id, unnest([CASE WHEN regexp_matches(path, '(^|/)\.\.(/|$)') THEN 'PATH_ESCAPE' END, CASE WHEN regexp_matches(path, '^(/|[A-Za-z]:)') THEN 'ABSOLUTE_PATH' END, CASE WHEN path NOT IN (SELECT path FROM k WHERE path IS NOT NULL) THEN 'STALE_ENTRY' END, CASE WHEN page_id > f THEN 'DUPLICATE_OF_LINE_' || f END]) AS code FROM f) WHERE code IS NOT NULL")
def q8_11_lint_exclusions(t):
    e = t("pages").select("page_id", F.regexp_extract("url", "://[^/]*/?(.*)$", 1).alias("path"))
    return C.lint_exclusions(e, e.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("path"), "page_id", "path")
