
from __future__ import annotations

from pyspark.sql import functions as F

from lodestat.operators import profiles as P
from lodestat.plans.registry import query, rounded

SIZES = [0, 10, 20, 30, 40, 51]


@query("SELECT defect, CAST(n AS BIGINT) AS n, round(n / a, 6) AS share FROM (SELECT count(*) AS a, count(*) FILTER (WHERE text IS NULL OR text = '') AS empty_text, count(*) FILTER (WHERE n_chars < 50) AS short_text, count(*) FILTER (WHERE quality IS NULL) AS unlabelled, count(*) FILTER (WHERE toxic = 1) AS toxic FROM documents LEFT JOIN labels USING (doc_id)) UNPIVOT (n FOR defect IN (empty_text, short_text, unlabelled, toxic))")
def q4_15_defects(t):
    j = t("documents").join(t("labels"), "doc_id", "left")
    c = F.col
    return rounded(P.defect_counts(j, {"empty_text": c("text").isNull() | (c("text") == ""), "short_text": c("n_chars") < 50, "unlabelled": c("quality").isNull(), "toxic": c("toxic") == 1}))


@query("WITH c AS (SELECT p_type, least(p_size // 10, 4) AS cell, count(*) AS n FROM part GROUP BY 1, 2), g AS (SELECT DISTINCT p_type, unnest(range(5)) AS cell FROM part) SELECT p_type, CAST(g.cell AS BIGINT) AS cell, CAST(coalesce(n, 0) AS BIGINT) AS n, round(coalesce(n, 0) * count(*) OVER () / sum(coalesce(n, 0)) OVER (), 6) AS ratio FROM g LEFT JOIN c USING (p_type, cell)")
def q4_20_joint_fill(t):
    cell = F.least(F.floor(F.col("p_size") / 10), F.lit(4)).cast("int")
    return rounded(P.joint_fill(t("part"), cell, "p_type", 5).withColumn("cell", F.col("cell").cast("bigint")))


@query("SELECT CAST(floor(l_quantity / 10) AS BIGINT) AS bin, count(*) AS n, round(avg(CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0 END), 6) AS accept_rate, round(quantile_cont(l_extendedprice, 0.5) FILTER (WHERE l_returnflag = 'N'), 6) AS q50, round(quantile_cont(l_extendedprice, 0.95) FILTER (WHERE l_returnflag = 'N'), 6) AS q95 FROM lineitem GROUP BY 1")
def q4_21_bin_profile(t):
    return rounded(P.bin_profile(t("lineitem"), F.floor(F.col("l_quantity") / 10), F.col("l_returnflag") == "N", "l_extendedprice"))


WILSON = "round((k / n + 1.96 * 1.96 / (2 * n) {sign} 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n), 6)"


@query(f"SELECT denominator, k, n, round(k / n, 6) AS rate, {WILSON.format(sign='-')} AS lo, {WILSON.format(sign='+')} AS hi FROM (SELECT 'proposal' AS denominator, count(*) FILTER (WHERE o_orderstatus = 'F') AS k, count(*) AS n FROM orders UNION ALL SELECT 'expensive', count(*) FILTER (WHERE o_orderstatus = 'F' AND o_totalprice > 200000), count(*) FILTER (WHERE o_totalprice > 200000) FROM orders)")
def q4_22_yields(t):
    return rounded(P.yields(t("orders"), F.col("o_orderstatus") == "F", {"proposal": F.lit(True), "expensive": F.col("o_totalprice") > 200000}))


@query("SELECT flag, value, count(*) AS n, round(avg(p_retailprice), 6) AS mean FROM (SELECT 'large' AS flag, p_size > 25 AS value, p_retailprice FROM part UNION ALL SELECT 'even', p_partkey % 2 = 0, p_retailprice FROM part) GROUP BY 1, 2")
def q4_28_candidate_profile(t):
    return rounded(P.candidate_profile(t("part"), {"large": F.col("p_size") > 25, "even": F.col("p_partkey") % 2 == 0}, "p_retailprice"))


@query("SELECT user_id, count(step) AS measured, count(*) - count(step) AS unmeasured, round(avg(CASE WHEN step <= 50 THEN 1.0 WHEN step IS NOT NULL THEN 0 END), 6) AS pass_rate, round(max(step), 6) AS max_step, round(min(50 - step), 6) AS min_margin FROM (SELECT user_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS step FROM events) GROUP BY 1")
def q4_32_continuity(t):
    return rounded(P.continuity_summary(t("events"), "user_id", ["ts", "event_id"], "value", 50.0))


@query("SELECT bin, n, share, share >= 0.1 AS covered FROM (SELECT least(p_size // 10, 4) AS bin, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM part GROUP BY 1)")
def q4_34_coverage(t):
    return rounded(P.coverage(t("part"), "p_size", SIZES, 0.1))


@query("SELECT statistic, round(value, 6) AS value FROM (SELECT CAST(count(*) AS DOUBLE) AS rows, CAST(count(DISTINCT l_orderkey) AS DOUBLE) AS distinct_keys, min(l_quantity) AS min, quantile_cont(l_quantity, 0.5) AS median, quantile_cont(l_quantity, 0.95) AS p95, max(l_quantity) AS max FROM lineitem) UNPIVOT (value FOR statistic IN (rows, distinct_keys, min, median, p95, max))")
def q4_36_dataset_stats(t):
    return rounded(P.dataset_stats(t("lineitem"), "l_quantity", "l_orderkey"))


@query("WITH r AS (SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part) SELECT p_brand, kind, p_partkey, p_retailprice FROM r JOIN (VALUES ('min'), ('mid'), ('max')) AS k(kind) ON r = CASE kind WHEN 'min' THEN 1 WHEN 'mid' THEN n // 2 + 1 ELSE n END")
def q6_02_extremes(t):
    return P.pick_extremes(t("part"), "p_brand", "p_retailprice", "p_partkey")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_discount <= 0.05 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC NULLS LAST, l_linenumber) = 1")
def q6_05_seed(t):
    return P.select_seed(t("lineitem"), "l_orderkey", "l_extendedprice", "l_linenumber", F.col("l_discount") <= 0.05)


@query("SELECT count(o_totalprice) AS valid, count(*) - count(o_totalprice) AS missing, count(*) FILTER (WHERE o_totalprice < 1000 OR o_totalprice > 300000) AS outside, round(quantile_cont(o_totalprice, 0.05), 6) AS q05, round(quantile_cont(o_totalprice, 0.25), 6) AS q25, round(quantile_cont(o_totalprice, 0.5), 6) AS q50, round(quantile_cont(o_totalprice, 0.75), 6) AS q75, round(quantile_cont(o_totalprice, 0.95), 6) AS q95, round(avg(o_totalprice), 6) AS mean FROM orders")
def q9_03_profile(t):
    return rounded(P.profile(t("orders"), "o_totalprice", 1000, 300000))


@query("WITH d AS (SELECT count(*) AS delivered, max(o_orderkey) AS last FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY 1 LIMIT 500)), a AS (SELECT CASE WHEN delivered < 500 THEN count(*) ELSE count(*) FILTER (WHERE o_orderkey <= last) END AS attempts, delivered FROM orders, d GROUP BY delivered, last) SELECT attempts, delivered, CASE WHEN attempts > 5000 THEN 'cap_hit' WHEN delivered = 500 THEN 'complete' ELSE 'incomplete' END AS status FROM a")
def q12_06_completion(t):
    return P.completion_status(t("orders"), "o_orderkey", F.col("o_orderstatus") == "F", 500, 5000)
