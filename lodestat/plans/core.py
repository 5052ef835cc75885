"""Queries on the driver tables for scans, gates, joins, aggregates, windows, picks, comparison, duplicates, statistics and sampling.

"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestat.functions import scalars as S
from lodestat.operators import density as D
from lodestat.operators import tables as O
from lodestat.plans.registry import query, rounded

LATE = "l_shipdate > timestamp '1996-01-01'"


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, props IS NOT NULL AND try_cast(json_extract_string(props, '$.k') AS BIGINT) IS NULL AS bad FROM events")
def q1_01_record_scan(t):
    k = F.from_json("props", "struct<k:string>")["k"].try_cast("bigint")
    return t("events").select("event_id", k.alias("k"), (F.col("props").isNotNull() & k.isNull()).alias("bad"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def q1_02_latest_by_key(t):
    return O.latest_by_key(t("events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT o_orderkey, c_name, c_nationkey, concat_ws('x', CAST(o_orderkey AS VARCHAR), CAST(c_nationkey AS VARCHAR)) AS tag FROM orders JOIN customer ON o_custkey = c_custkey")
def q1_03_label_flatten(t):
    nested = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.struct("o_orderkey", F.array(F.struct("c_name", "c_nationkey")).alias("objects")).alias("label"))
    first = F.try_element_at("label.objects", F.lit(1))
    return nested.select("label.o_orderkey", first.c_name.alias("c_name"), first.c_nationkey.alias("c_nationkey"), F.concat_ws("x", F.col("label.o_orderkey").cast("string"), first.c_nationkey.cast("string")).alias("tag"))


@query("SELECT DISTINCT id FROM (SELECT try_cast(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) AS id FROM pages UNION ALL SELECT doc_id FROM documents) WHERE id IS NOT NULL")
def q1_04_artefact_ids(t):
    a = t("pages").select(F.regexp_extract("url", "/([0-9]+)", 1).try_cast("bigint").alias("id"))
    return a.union(t("documents").select("doc_id")).where("id is not null").distinct()


@query("SELECT doc_id, CAST(i AS BIGINT) AS line_no, line FROM (SELECT doc_id, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)) WHERE regexp_matches(line, '(?i)licen[sc]e|copyright')")
def q1_05_log_scan(t):
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return lines.where(F.col("line").rlike("(?i)licen[sc]e|copyright")).select("doc_id", (F.col("i") + 1).cast("bigint").alias("line_no"), "line")


@query("SELECT l_returnflag, 'mean_qty' AS statistic, round(avg(l_quantity), 6) AS value FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, 'max_qty', round(max(l_quantity), 6) FROM lineitem GROUP BY 1")
def q1_07_long_metrics(t):
    w = t("lineitem").groupBy("l_returnflag").agg(F.avg("l_quantity").alias("mean_qty"), F.max("l_quantity").alias("max_qty"))
    return rounded(w.unpivot("l_returnflag", ["mean_qty", "max_qty"], "statistic", "value"))


@query("SELECT o_orderkey, format('f{:08d}', o_orderkey) AS frame_id FROM orders WHERE o_orderstatus = 'F'")
def q1_08_delivered_manifest(t):
    return t("orders").where("o_orderstatus = 'F'").select("o_orderkey", F.format_string("f%08d", "o_orderkey").alias("frame_id"))


@query("SELECT l_orderkey, l_linenumber, coalesce(l_discount, l_tax) AS picked FROM lineitem")
def q2_01_pick(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", S.pick(S.present(F.col("l_discount")), S.present(F.col("l_tax"))).alias("picked"))


@query("SELECT p_partkey, try_cast(substr(p_brand, 7) AS BIGINT) AS brand_no, try_cast(string_split(p_name, ' ')[1] AS DOUBLE) AS word_no FROM part")
def q2_03_typed(t):
    return t("part").select("p_partkey", S.as_int(F.substring("p_brand", 7, 100)).alias("brand_no"), S.as_float(F.split("p_name", " ")[0]).alias("word_no"))


@query("SELECT coalesce(nullif(trim(CAST(nullif(l_linenumber, 3) AS VARCHAR)), ''), '(missing)') AS label, count(*) AS n FROM lineitem GROUP BY 1")
def q2_04_group_label(t):
    return O.count_by(t("lineitem"), F.nullif(F.col("l_linenumber"), F.lit(3)))


@query("SELECT CASE WHEN l_quantity < 10 THEN 'qty <10' WHEN l_quantity < 20 THEN 'qty [10,20)' WHEN l_quantity < 30 THEN 'qty [20,30)' WHEN l_quantity < 40 THEN 'qty [30,40)' ELSE 'qty >=40' END AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def q2_05_numeric_bin(t):
    return t("lineitem").groupBy(S.numeric_bin(F.col("l_quantity"), [10, 20, 30, 40], "qty").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


GATES = "CASE WHEN l_quantity > 40 THEN NULL ELSE l_quantity < 30 END AS g1, l_discount <= 0.06 AS g2, l_tax < 0.07 AS g3"


def gates():
    return {"g1": F.when(F.col("l_quantity") <= 40, F.col("l_quantity") < 30), "g2": F.col("l_discount") <= 0.06, "g3": F.col("l_tax") < 0.07}


@query(f"""SELECT l_orderkey, l_linenumber, concat_ws('|', CASE WHEN g1 = false THEN 'g1' END, CASE WHEN g2 = false THEN 'g2' END, CASE WHEN g3 = false THEN 'g3' END) AS failed,
CASE WHEN g1 IS NULL THEN 'g1' ELSE '' END AS unknown, coalesce(g1 AND g2 AND g3, false) AS usable FROM (SELECT *, {GATES} FROM lineitem)""")
def q2_06_conditions(t):
    g = gates()
    failed, unknown = S.conditions(g)
    return t("lineitem").select("l_orderkey", "l_linenumber", F.array_join(failed, "|").alias("failed"), F.array_join(unknown, "|").alias("unknown"), S.all_pass(*g.values()).alias("usable"))


@query(f"""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN coalesce(g1 AND g2 AND g3, false) THEN 'accepted' ELSE coalesce(nullif(concat_ws('|', CASE WHEN g1 = false THEN 'g1' END, CASE WHEN g2 = false THEN 'g2' END, CASE WHEN g3 = false THEN 'g3' END), ''), 'realize_fail:unknown') END AS reason FROM (SELECT *, {GATES} FROM lineitem)) GROUP BY 1""")
def q2_07_primary_reason(t):
    failed, _ = S.conditions(gates())
    reason = F.when(S.all_pass(*gates().values()), "accepted").otherwise(F.coalesce(F.nullif(F.array_join(failed, "|"), F.lit("")), F.lit("realize_fail:unknown")))
    return t("lineitem").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, concat_ws('|', CASE WHEN o_totalprice <= 0 THEN 'price' END, CASE WHEN c_acctbal < 0 THEN 'balance' END) AS violations, o_totalprice > 0 AND c_acctbal >= 0 AS valid FROM orders JOIN customer ON o_custkey = c_custkey")
def q2_08_validity(t):
    j = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    c = {"price": F.col("o_totalprice") > 0, "balance": F.col("c_acctbal") >= 0}
    return j.select("o_orderkey", F.array_join(S.conditions(c)[0], "|").alias("violations"), S.all_pass(*c.values()).alias("valid"))


@query("SELECT p_partkey, p_size >= 16 AS ok_2, p_size >= 24 AS ok_3, p_size >= 32 AS ok_4 FROM part")
def q2_09_size_flags(t):
    return t("part").select("p_partkey", *((F.col("p_size") >= 8 * k).alias(f"ok_{k}") for k in (2, 3, 4)))


@query("SELECT d.doc_id, concat_ws(';', CASE WHEN length(text) < 200 THEN 'short' END, CASE WHEN l.doc_id IS NULL THEN 'no_label' END, CASE WHEN quality = 0 THEN 'low_quality' END) AS tokens FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def q2_10_failure_lists(t):
    j = t("documents").join(t("labels").select(F.col("doc_id").alias("l"), "quality"), F.col("doc_id") == F.col("l"), "left")
    return j.select("doc_id", F.concat_ws(";", F.when(F.length("text") < 200, "short"), F.when(F.col("l").isNull(), "no_label"), F.when(F.col("quality") == 0, "low_quality")).alias("tokens"))


@query("SELECT event_type, count(*) AS n, CAST(sum(CASE WHEN CASE event_type WHEN 'click' THEN value > 10 WHEN 'view' THEN value > 1 ELSE value IS NOT NULL END THEN 1 ELSE 0 END) AS BIGINT) AS ok FROM events GROUP BY 1")
def q2_11_mode_semantics(t):
    rule = F.when(F.col("event_type") == "click", F.col("value") > 10).when(F.col("event_type") == "view", F.col("value") > 1).otherwise(F.col("value").isNotNull())
    return t("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), S.count_true(rule).alias("ok"))


@query("SELECT l_orderkey, l_linenumber, round(least(l_quantity - 5, 45 - l_quantity), 6) AS m_qty, round(0.08 - l_discount, 6) AS m_disc, CAST((least(l_quantity - 5, 45 - l_quantity) < 0)::INT + (round(0.08 - l_discount, 6) < 0)::INT AS BIGINT) AS violation_count FROM lineitem")
def q2_12_constraint_vector(t):
    q, d = F.round(F.least(F.col("l_quantity") - 5, 45 - F.col("l_quantity")), 6), F.round(0.08 - F.col("l_discount"), 6)
    return t("lineitem").select("l_orderkey", "l_linenumber", q.alias("m_qty"), d.alias("m_disc"), ((q < 0).cast("bigint") + (d < 0).cast("bigint")).alias("violation_count"))


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN g1 = false THEN 'g1' WHEN g2 = false THEN 'g2' ELSE 'g3' END AS blocked_by FROM (SELECT *, {GATES} FROM lineitem) WHERE g1 IS NOT NULL AND (g1 = false)::INT + (g2 = false)::INT + (g3 = false)::INT = 1")
def q2_13_near_miss(t):
    failed, unknown = S.conditions(gates())
    return t("lineitem").where((F.size(failed) == 1) & (F.size(unknown) == 0)).select("l_orderkey", "l_linenumber", F.get(failed, F.lit(0)).alias("blocked_by"))


PARTS = {"discount": "l_discount", "tax": "l_tax", "qty": "l_quantity / 500"}


@query("SELECT l_orderkey, l_linenumber, CASE WHEN greatest(l_discount, l_tax, l_quantity / 500) = 0 THEN 'none' WHEN l_discount >= l_tax AND l_discount >= l_quantity / 500 THEN 'discount' WHEN l_tax >= l_quantity / 500 THEN 'tax' ELSE 'qty' END AS dominant FROM lineitem")
def q2_16_dominant(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", S.argmax_label({k: F.expr(v) for k, v in PARTS.items()}).alias("dominant"))


@query("SELECT o_orderkey, coalesce(nullif(concat_ws('|', CASE WHEN o_totalprice > 200000 THEN 'G1' END, CASE WHEN o_orderstatus = 'O' THEN 'G3' END), ''), 'accepted') AS reason FROM orders")
def q2_17_reason(t):
    r = F.concat_ws("|", F.when(F.col("o_totalprice") > 200000, "G1"), F.when(F.col("o_orderstatus") == "O", "G3"))
    return t("orders").select("o_orderkey", F.coalesce(F.nullif(r, F.lit("")), F.lit("accepted")).alias("reason"))


@query("SELECT p_partkey, p_type LIKE '%BRASS%' AS indoor, p_brand IN ('Brand#11', 'Brand#12') AS outdoor FROM part")
def q2_20_domain_rule(t):
    return t("part").select("p_partkey", F.col("p_type").contains("BRASS").alias("indoor"), F.col("p_brand").isin("Brand#11", "Brand#12").alias("outdoor"))


@query("SELECT CASE WHEN p_size < 5 THEN 'too_small' WHEN p_retailprice > 1500 THEN 'too_dear' WHEN p_size > 45 THEN 'too_big' END AS reason, count(*) AS n FROM part GROUP BY 1")
def q2_21_prefilter(t):
    r = F.when(F.col("p_size") < 5, "too_small").when(F.col("p_retailprice") > 1500, "too_dear").when(F.col("p_size") > 45, "too_big")
    return t("part").groupBy(r.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.doc_id IS NOT NULL AS has_text, l.doc_id IS NOT NULL AS has_label FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def q3_01_presence(t):
    return O.presence_matrix("doc_id", text=t("documents"), label=t("labels"))


@query("SELECT k, CASE WHEN c AND o THEN 'paired' WHEN c THEN 'orphan_left' ELSE 'orphan_right' END AS state FROM (SELECT k, bool_or(s = 1) AS c, bool_or(s = 2) AS o FROM (SELECT c_custkey AS k, 1 AS s FROM customer UNION ALL SELECT o_custkey, 2 FROM orders) GROUP BY k)")
def q3_02_pair_check(t):
    return O.pair_check(t("customer").select(F.col("c_custkey").alias("k")), t("orders").select(F.col("o_custkey").alias("k")), "k")


@query("SELECT l_orderkey, l_linenumber, p_name FROM (SELECT *, 'Brand#' || CAST(11 + l_linenumber AS VARCHAR) AS brand FROM lineitem) LEFT JOIN part ON l_partkey = p_partkey AND brand = p_brand")
def q3_03_guarded_join(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("k"), F.concat(F.lit("Brand#"), (11 + F.col("l_linenumber")).cast("string")).alias("brand"))
    return O.guarded_join(rows, t("part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("brand"), "p_name"), "k", "brand").select("l_orderkey", "l_linenumber", "p_name")


HALF = "SELECT l_partkey AS k, avg(l_quantity) AS v, avg(l_discount) > 0.05 AS g, avg(l_tax) AS e FROM lineitem WHERE l_shipdate {} TIMESTAMP '1996-01-01' GROUP BY 1"


@query(f"SELECT count(*) AS n_cases, CAST(sum((NOT b.g AND n.g)::INT) AS BIGINT) AS recovered, CAST(sum((b.g AND NOT n.g)::INT) AS BIGINT) AS regressed, round(quantile_cont(b.v, 0.5), 6) AS median_base, round(quantile_cont(n.v, 0.5), 6) AS median_new, round(quantile_cont(n.v - b.v, 0.5), 6) AS delta_value, round(quantile_cont(n.e - b.e, 0.5) FILTER (b.g AND n.g), 6) AS delta_error, round(list_sort(list(b.v))[CAST(least(count(*) - 1, floor(0.95::DOUBLE * count(*))) AS BIGINT) + 1], 6) AS p95_base, round(list_sort(list(n.v))[CAST(least(count(*) - 1, floor(0.95::DOUBLE * count(*))) AS BIGINT) + 1], 6) AS p95_new FROM ({HALF.format('<=')}) b JOIN ({HALF.format('>')}) n USING (k)")
def q3_04_paired_compare(t):
    """Many means are the limit itself, so doubles are added in the order of the rows, as the SQL does on one thread."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    rows = t("lineitem").select(F.col("l_partkey").alias("k"), "l_quantity", "l_discount", "l_tax", "l_shipdate", *place)
    means = lambda c: O.means_in_order(rows.where(c), "k", ["file", "row"], v=F.col("l_quantity"), d=F.col("l_discount"), e=F.col("l_tax"))
    half = lambda c: means(c).withColumn("g", F.col("d") > 0.05)
    return rounded(O.paired_compare(half(f"not ({LATE})"), half(LATE), "k", "v", "g", "e"))


@query("SELECT n_nationkey, n_name, CASE WHEN c.c_nationkey IS NULL THEN 'missing' ELSE 'ok' END AS state FROM nation LEFT JOIN (SELECT DISTINCT c_nationkey FROM customer) c ON n_nationkey = c.c_nationkey")
def q3_07_registry(t):
    used = t("customer").select(F.col("c_nationkey").alias("_k")).distinct()
    return t("nation").join(used, F.col("n_nationkey") == F.col("_k"), "left").select("n_nationkey", "n_name", F.when(F.col("_k").isNull(), "missing").otherwise("ok").alias("state"))


@query("SELECT p.page_id, o.root FROM pages p JOIN (SELECT regexp_extract(url, '^([a-z]+://[^/]+/[a-z]+)', 1) AS root FROM pages GROUP BY 1 HAVING count(*) > 1) o ON o.root <> '' AND (p.url = o.root OR starts_with(p.url, o.root || '/'))")
def q3_08_prefix_conflicts(t):
    roots = t("pages").groupBy(F.regexp_extract("url", "^([a-z]+://[^/]+/[a-z]+)", 1).alias("root")).agg(F.count(F.lit(1)).alias("n"))
    owned = roots.where("root <> '' and n > 1").select("root")
    return O.prefix_conflicts(t("pages").select("page_id", "url"), owned, "url", "root").select("page_id", "root")


@query("SELECT doc_id, source, CASE WHEN source IN ('src1', 'src2') THEN 'excluded' WHEN source IN ('src3', 'src4', 'src5') THEN 'licensed' ELSE 'unknown' END AS verdict FROM documents")
def q3_09_license_check(t):
    spark = t("documents").sparkSession
    ledger = spark.createDataFrame([("src1", "excluded"), ("src2", "excluded"), ("src3", "licensed"), ("src4", "licensed"), ("src5", "licensed")], "source string, v string")
    return t("documents").join(F.broadcast(ledger), "source", "left").select("doc_id", "source", F.coalesce("v", F.lit("unknown")).alias("verdict"))


@query("SELECT event_type AS label, count(*) AS n FROM events GROUP BY 1")
def q4_01_counter(t):
    return O.count_by(t("events"), "event_type")


@query("SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, min(l_extendedprice) AS lo, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1")
def q4_02_numeric_summary(t):
    return rounded(O.summarize_numeric(t("lineitem"), "l_extendedprice", ["l_returnflag"]), 4)


@query("SELECT l_returnflag, p, q FROM (SELECT l_returnflag, p, list_sort(list(l_quantity)) AS v FROM lineitem, (VALUES (0.5), (0.9), (0.95)) AS x(p) GROUP BY 1, 2) s, LATERAL (SELECT v[CAST(least(len(v) - 1, floor(p * len(v))) AS BIGINT) + 1] AS q)".replace("VALUES (0.5), (0.9), (0.95)", "VALUES (0.5::DOUBLE), (0.9::DOUBLE), (0.95::DOUBLE)"))
def q4_03_rank_quantiles(t):
    return O.quantile_rank(t("lineitem"), "l_quantity", [0.5, 0.9, 0.95], "l_returnflag")


WILSON = "round(greatest((p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n), 0), 6) AS rate_lo, round(least((p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n), 1), 6) AS rate_hi"


@query(f"SELECT o_orderpriority, n, passed, round(p, 6) AS rate, {WILSON} FROM (SELECT o_orderpriority, count(*) AS n, CAST(sum((o_orderstatus = 'F')::INT) AS BIGINT) AS passed, avg((o_orderstatus = 'F')::INT) AS p FROM orders GROUP BY 1)")
def q4_04_rate_by(t):
    return rounded(O.rate_by(t("orders"), F.col("o_orderstatus") == "F", ["o_orderpriority"]))


@query(f"SELECT l_returnflag, count(*) AS n, CAST(sum((coalesce(g1 AND g2 AND g3, false))::INT) AS BIGINT) AS all_pass, CAST(count(*) FILTER (WHERE g1 = false) AS BIGINT) AS fail_g1, CAST(count(*) FILTER (WHERE g2 = false) AS BIGINT) AS fail_g2, CAST(count(*) FILTER (WHERE g3 = false) AS BIGINT) AS fail_g3, grouping(l_returnflag) = 1 AS is_total FROM (SELECT *, {GATES} FROM lineitem) GROUP BY ROLLUP (l_returnflag)")
def q4_05_run_summary(t):
    return O.summarize_run(t("lineitem"), "l_returnflag", gates())


@query("SELECT o_orderstatus, CAST(count(*) FILTER (WHERE year(o_orderdate) = 1996) AS BIGINT) - CAST(count(*) FILTER (WHERE year(o_orderdate) = 1995) AS BIGINT) AS delta FROM orders WHERE year(o_orderdate) IN (1995, 1996) GROUP BY 1")
def q4_06_run_delta(t):
    y = F.year("o_orderdate")
    return t("orders").where(y.isin(1995, 1996)).groupBy("o_orderstatus").agg((S.count_true(y == 1996) - S.count_true(y == 1995)).alias("delta"))


@query("SELECT l_returnflag, round(avg(l_discount), 6) AS discount, round(avg(l_tax), 6) AS tax, round(avg(l_quantity / 500), 6) AS qty FROM lineitem GROUP BY 1")
def q4_07_component_means(t):
    return rounded(t("lineitem").groupBy("l_returnflag").agg(*(F.avg(F.expr(v)).alias(k) for k, v in PARTS.items())))


@query("SELECT dominant, count(*) AS n, round(avg((l_returnflag = 'R')::INT), 6) AS fail_rate FROM (SELECT l_returnflag, CASE WHEN greatest(l_discount, l_tax, l_quantity / 500) = 0 THEN 'none' WHEN l_discount >= l_tax AND l_discount >= l_quantity / 500 THEN 'discount' WHEN l_tax >= l_quantity / 500 THEN 'tax' ELSE 'qty' END AS dominant FROM lineitem) GROUP BY 1")
def q4_08_fail_by_source(t):
    d = S.argmax_label({k: F.expr(v) for k, v in PARTS.items()})
    return rounded(t("lineitem").groupBy(d.alias("dominant")).agg(F.count(F.lit(1)).alias("n"), S.share_true(F.col("l_returnflag") == "R").alias("fail_rate")))


@query("SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'O') AS O, count(*) FILTER (WHERE l_linestatus = 'F') AS F FROM lineitem GROUP BY 1")
def q4_09_cross_tab(t):
    return O.cross_tab(t("lineitem"), "l_returnflag", "l_linestatus", ["O", "F"])


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus), 6) AS share FROM orders GROUP BY 1, 2")
def q4_10_reason_table(t):
    return rounded(O.share_table(t("orders"), "o_orderstatus", "o_orderpriority"))


@query("SELECT 'k' AS key, round(sum(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 4) AS total, count(json_extract_string(props, '$.k')) AS n FROM events")
def q4_11_sum_map(t):
    return rounded(O.sum_map(t("events"), "props"), 4)


@query("SELECT token, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS token FROM part) WHERE token <> '' GROUP BY 1")
def q4_12_tokens(t):
    return O.count_tokens(t("part"), "p_name", " ")


@query("SELECT coalesce(nullif(CASE WHEN l_tax > 0.04 THEN 'T' ELSE '' END || CASE WHEN l_quantity > 25 THEN 'O' ELSE '' END || CASE WHEN l_discount > 0.05 THEN 'C' ELSE '' END, ''), 'none') AS combo, count(*) AS n FROM lineitem GROUP BY 1")
def q4_13_flag_combos(t):
    return O.flag_combos(t("lineitem"), {"T": F.col("l_tax") > 0.04, "O": F.col("l_quantity") > 25, "C": F.col("l_discount") > 0.05})


@query("SELECT CAST(least(floor((l_quantity - lo) / ((hi - lo) / 10)), 9) AS INT) AS bin, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM lineitem, (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem) GROUP BY 1")
def q4_14_histogram(t):
    return rounded(O.histogram(t("lineitem"), "l_quantity", 10))


@query("""SELECT axis, key, prescribed, coalesce(accepted_n, 0) AS accepted_n, round(coalesce(tried, 0) / all_tried, 6) AS attempted_frac, round(coalesce(accepted_n, 0) / all_accepted, 6) AS accepted_frac, round(abs(coalesce(accepted_n, 0) / all_accepted - prescribed), 6) AS abs_error, prescribed > 0 AND coalesce(accepted_n, 0) = 0 AS starved
FROM (VALUES ('p_size', '1', 0.1::DOUBLE), ('p_size', '50', 0.2::DOUBLE), ('p_brand', 'Brand#11', 0.04::DOUBLE), ('p_brand', 'Brand#99', 0.5::DOUBLE)) AS pr(axis, key, prescribed)
LEFT JOIN (SELECT axis, key, count(*) AS tried, CAST(sum((p_retailprice > 1000)::INT) AS BIGINT) AS accepted_n FROM (SELECT 'p_size' AS axis, CAST(p_size AS VARCHAR) AS key, p_retailprice FROM part UNION ALL SELECT 'p_brand', p_brand, p_retailprice FROM part) GROUP BY 1, 2) USING (axis, key)
CROSS JOIN (SELECT count(*) AS all_tried, sum((p_retailprice > 1000)::INT) AS all_accepted FROM part)""")
def q4_16_axis_marginals(t):
    spark = t("part").sparkSession
    want = spark.createDataFrame([("p_size", "1", 0.1), ("p_size", "50", 0.2), ("p_brand", "Brand#11", 0.04), ("p_brand", "Brand#99", 0.5)], "axis string, key string, prescribed double")
    out = O.axis_marginals(t("part"), ["p_size", "p_brand"], want, F.col("p_retailprice") > 1000)
    return rounded(out.drop("all_accepted"))


@query("SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 2) AS mean, round(quantile_cont(o_totalprice, 0.5), 2) AS median, round(quantile_cont(o_totalprice, 0.9), 2) AS p90, round(quantile_cont(o_totalprice, 0.95), 2) AS p95, max(o_totalprice) AS hi FROM orders GROUP BY 1")
def q4_23_cost_by(t):
    return rounded(O.cost_by(t("orders"), "o_orderpriority", "o_totalprice"), 2)


@query("SELECT p_brand, round(total, 2) AS total, round(total / sum(total) OVER (), 6) AS share, CAST(row_number() OVER (ORDER BY total DESC, p_brand) AS INT) AS rank, round(sum(total) OVER (ORDER BY total DESC, p_brand) / sum(total) OVER (), 6) AS cum_share FROM (SELECT p_brand, sum(CAST(p_retailprice AS DECIMAL(18,2))) AS total FROM part GROUP BY 1)".replace("round(total, 2) AS total", "CAST(total AS DOUBLE) AS total"))
def q4_24_cost_share(t):
    df = O.cost_share(t("part").select("p_brand", F.col("p_retailprice").cast("decimal(18,2)").cast("double").alias("c")), "p_brand", "c")
    return df.select("p_brand", F.round("total", 2).alias("total"), F.round("share", 6).alias("share"), "rank", F.round("cum_share", 6).alias("cum_share"))


@query(f"SELECT l_orderkey, CASE m WHEN 0 THEN 'ACCEPTED' WHEN 1 THEN 'ONE_MISS_' || sig WHEN 2 THEN 'TWO_MISS_' || sig ELSE 'MULTI' END AS signature FROM (SELECT l_orderkey, min(c) AS m, arg_min(sig, lpad(CAST(c AS VARCHAR), 3, '0') || sig) AS sig FROM (SELECT l_orderkey, (g1 = false)::INT + (g2 = false)::INT + (g3 = false)::INT AS c, concat_ws('_', CASE WHEN g1 = false THEN 'g1' END, CASE WHEN g2 = false THEN 'g2' END, CASE WHEN g3 = false THEN 'g3' END) AS sig FROM (SELECT *, l_quantity < 30 AS g1, l_discount <= 0.06 AS g2, l_tax < 0.07 AS g3 FROM lineitem)) GROUP BY 1)")
def q4_25_binding_signature(t):
    failed, _ = S.conditions({"g1": F.col("l_quantity") < 30, "g2": F.col("l_discount") <= 0.06, "g3": F.col("l_tax") < 0.07})
    c = t("lineitem").select("l_orderkey", F.struct(F.size(failed).alias("c"), F.array_join(failed, "_").alias("sig")).alias("s"))
    best = c.groupBy("l_orderkey").agg(F.min("s").alias("s"))
    say = F.when(F.col("s.c") == 0, "ACCEPTED").when(F.col("s.c") == 1, F.concat(F.lit("ONE_MISS_"), "s.sig")).when(F.col("s.c") == 2, F.concat(F.lit("TWO_MISS_"), "s.sig")).otherwise("MULTI")
    return best.select("l_orderkey", say.alias("signature"))


@query("SELECT t AS threshold, CAST(sum((p_size >= t)::INT) AS BIGINT) AS n, round(avg((p_size >= t)::INT), 6) AS share, round(avg(p_retailprice) FILTER (WHERE p_size >= t), 4) AS mean FROM part, (VALUES (8.0::DOUBLE), (16.0::DOUBLE), (24.0::DOUBLE), (32.0::DOUBLE), (40.0::DOUBLE)) AS x(t) GROUP BY 1")
def q4_26_threshold_sweep(t):
    s = O.threshold_sweep(t("part"), "p_size", [8, 16, 24, 32, 40], F.col("p_retailprice"))
    return s.select("threshold", "n", F.round("share", 6).alias("share"), F.round("mean", 4).alias("mean"))


@query("SELECT CAST(CASE WHEN p_size < 10 THEN 0 WHEN p_size < 25 THEN 1 ELSE 2 END AS INT) AS stratum, count(*) AS n, round(avg(p_retailprice), 4) AS mean FROM part WHERE p_size BETWEEN 0 AND 50 GROUP BY 1")
def q4_27_strata(t):
    return rounded(t("part").withColumn("stratum", S.bin_index(F.col("p_size"), [0, 10, 25, 50])).where("stratum is not null").groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.avg("p_retailprice").alias("mean")), 4)


@query("SELECT after, before, before - after - 1 AS missing FROM (SELECT o_orderkey AS after, lead(o_orderkey) OVER (ORDER BY o_orderkey) AS before FROM (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderstatus = 'F')) WHERE before - after > 1")
def q4_33_gaps(t):
    return O.sequence_gaps(t("orders").where("o_orderstatus = 'F'"), "o_orderkey", 1000)


@query("SELECT source, count(*) AS n_files, CAST(sum(n_chars) AS BIGINT) AS bytes, round(avg(n_chars), 4) AS mean, round(quantile_cont(n_chars, 0.95), 4) AS p95, round(avg(n_chars) * 1000000, 0) AS projected FROM documents GROUP BY 1")
def q4_35_storage(t):
    """p95 of the sizes and a projection to a million files."""
    g = O.agg_percentiles(t("documents"), ["source"], "n_chars", [0.95], F.count(F.lit(1)).alias("n_files"), F.sum("n_chars").alias("bytes"), F.round(F.avg("n_chars"), 4).alias("mean"), F.round(F.avg("n_chars") * 1000000, 0).alias("projected"))
    return g.select("source", "n_files", "bytes", "mean", F.round(F.get("q", F.lit(0)), 4).alias("p95"), "projected")


@query("SELECT event_type, CAST(floor((row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) / 10) AS BIGINT) AS block FROM events QUALIFY count(*) OVER (PARTITION BY event_type) >= 0".replace("SELECT event_type, CAST", "SELECT event_type, block, count(*) FILTER (WHERE user_id % 2 = 0) = 5 AS ok FROM (SELECT event_type, user_id, CAST").replace(" QUALIFY count(*) OVER (PARTITION BY event_type) >= 0", ") GROUP BY 1, 2 HAVING count(*) = 10"))
def q4_37_blocks(t):
    e = t("events").withColumn("kind", (F.col("user_id") % 2 == 0).cast("string"))
    return O.block_check(e, "event_type", "event_id", 10, "kind", {"true": 5})


@query("SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 4) AS mean_target, round(avg(l_extendedprice / l_quantity), 4) AS mean_actual, round(avg(l_extendedprice / l_quantity - p_retailprice), 4) AS bias, round(stddev_pop(l_extendedprice / l_quantity - p_retailprice), 4) AS bias_std, round(max(abs(l_extendedprice / l_quantity - p_retailprice)), 4) AS max_abs FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def q4_38_bias(t):
    j = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select("p_brand", "p_retailprice", (F.col("l_extendedprice") / F.col("l_quantity")).alias("a"))
    return rounded(O.bias_by(j, "p_retailprice", "a", "p_brand"), 4)


@query("SELECT l_returnflag, l_quantity, count(*) AS n, round(sum(count(*)) OVER (PARTITION BY l_returnflag ORDER BY l_quantity) / sum(count(*)) OVER (PARTITION BY l_returnflag), 6) AS y FROM lineitem GROUP BY 1, 2")
def q5_01_ecdf(t):
    return rounded(O.ecdf(t("lineitem"), "l_quantity", "l_returnflag"))


@query("SELECT DISTINCT p_retailprice, count(*) OVER (PARTITION BY p_retailprice) AS n, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0::DOUBLE AS rank FROM part")
def q5_02_avg_rank(t):
    return O.avg_rank(t("part"), "p_retailprice")


@query("SELECT user_id, count(*) AS n, round(max(d), 6) AS max_step, coalesce(max(d) <= 50, false) AS ok FROM (SELECT user_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS d FROM events) GROUP BY 1")
def q5_03_steps(t):
    return rounded(O.step_verdict(t("events"), "user_id", ["ts", "event_id"], "value", 50))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) > 1 AS is_repeat FROM events")
def q5_04_duplicates(t):
    return O.flag_duplicates(t("events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "is_repeat")


@query("SELECT doc_id, CAST(row_number() OVER (ORDER BY source, doc_id) - 1 AS BIGINT) AS number FROM documents")
def q5_05_renumber(t):
    return O.renumber(t("documents").select("doc_id", "source"), "source", "doc_id").select("doc_id", F.col("number").cast("bigint").alias("number"))


@query("SELECT doc_id, CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) <= 50000 AS within FROM documents")
def q5_07_budget(t):
    return O.budget_prefix(t("documents").select("doc_id", "source", "n_chars"), "source", "doc_id", "n_chars", 50000).select("doc_id", "running", "within")


@query("SELECT user_id, min(event_id) AS first_at, arg_min(value, event_id) AS first_value FROM events WHERE value > 0 GROUP BY 1")
def q5_08_first_nonzero(t):
    return O.first_nonzero(t("events"), "user_id", "event_id", "value")


@query("SELECT hour, n, n - lag(n) OVER (ORDER BY hour) AS delta FROM (SELECT date_trunc('day', ts) AS hour, count(*) AS n FROM events GROUP BY 1)".replace("hour", "day"))
def q5_09_throughput(t):
    from pyspark.sql.window import Window

    n = t("events").groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("delta", F.col("n") - F.lag("n").over(Window.partitionBy().orderBy("day")))


@query("SELECT o_orderstatus, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) WHERE i = round_even(0.9 * (n - 1), 0)")
def q6_01_quantile_pick(t):
    return O.quantile_pick(t("orders").select("o_orderstatus", "o_orderkey", "o_totalprice"), "o_orderstatus", "o_totalprice", "o_orderkey", 0.9)


@query("SELECT o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def q6_03_representative(t):
    return t("orders").groupBy("o_orderpriority").agg(F.min("o_orderkey").alias("o_orderkey"))


@query("SELECT o_orderkey, reasons FROM (SELECT o_orderkey, concat_ws('|', CASE WHEN o_totalprice > 300000 THEN 'dear' END, CASE WHEN o_orderstatus = 'P' THEN 'partial' END, CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' END) AS reasons, (o_totalprice > 300000)::INT + (o_orderstatus = 'P')::INT + (o_orderpriority = '1-URGENT')::INT AS c FROM orders) WHERE c > 0 ORDER BY c DESC, o_orderkey LIMIT 24")
def q6_04_rule_subset(t):
    rules = {"dear": F.col("o_totalprice") > 300000, "partial": F.col("o_orderstatus") == "P", "urgent": F.col("o_orderpriority") == "1-URGENT"}
    return O.rule_subset(t("orders"), "o_orderkey", rules, 24).select("o_orderkey", "reasons")


@query("SELECT p_partkey, p_brand, p_size, p_retailprice FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE a.p_brand = b.p_brand AND b.p_retailprice <= a.p_retailprice AND b.p_size >= a.p_size AND (b.p_retailprice < a.p_retailprice OR b.p_size > a.p_size))")
def q6_06_pareto(t):
    return O.pareto(t("part").select("p_partkey", "p_brand", "p_size", "p_retailprice"), "p_brand", "p_retailprice", "p_size").select("p_partkey", "p_brand", "p_size", "p_retailprice")


@query("SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r = 1")
def q6_07_champions(t):
    return O.champions(t("part"), "p_brand", "p_retailprice", "p_partkey")


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 20")
def q6_08_top_k(t):
    return O.top_k(t("lineitem"), "l_partkey", 20)


COPY = "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderstatus, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderdate >= '1997-01-01'"


def copies(t):
    a = t("orders").where("o_orderstatus <> 'P'").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    b = t("orders").where("o_orderdate >= '1997-01-01'").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"), "o_orderstatus", F.when(F.col("o_orderkey") % 11 == 0, "X").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))
    return a, b


LEFT = "SELECT o_orderkey, o_totalprice, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus <> 'P'"


@query(f"SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'left_only' WHEN a.o_orderkey IS NULL THEN 'right_only' WHEN a.o_orderstatus = b.o_orderstatus AND a.o_orderpriority = b.o_orderpriority THEN 'equal' ELSE 'differs' END AS state FROM ({LEFT}) a FULL JOIN ({COPY}) b ON a.o_orderkey = b.o_orderkey")
def q7_01_dataset_diff(t):
    return O.dataset_diff(*copies(t), "o_orderkey", ["o_totalprice"])


@query(f"SELECT a.o_orderkey, CASE WHEN a.o_totalprice <> b.o_totalprice THEN '$.o_totalprice' ELSE '$.o_orderpriority' END AS path FROM ({LEFT}) a JOIN ({COPY}) b ON a.o_orderkey = b.o_orderkey WHERE a.o_totalprice <> b.o_totalprice OR a.o_orderpriority <> b.o_orderpriority")
def q7_02_first_difference(t):
    return O.first_difference(*copies(t), "o_orderkey", ["o_totalprice", "o_orderstatus", "o_orderpriority"])


@query(f"SELECT f AS field, n FROM (SELECT CAST(sum((a.o_totalprice <> b.o_totalprice)::INT) AS BIGINT) AS o_totalprice, CAST(sum((a.o_orderpriority <> b.o_orderpriority)::INT) AS BIGINT) AS o_orderpriority FROM ({LEFT}) a JOIN ({COPY}) b ON a.o_orderkey = b.o_orderkey) UNPIVOT (n FOR f IN (o_totalprice, o_orderpriority))")
def q7_03_field_mismatches(t):
    return O.field_mismatches(*copies(t), "o_orderkey", ["o_totalprice", "o_orderpriority"])


@query("SELECT state, count(*) AS n FROM (SELECT k, CASE WHEN bool_or(y = 1995) AND bool_or(y = 1996) THEN 'both' WHEN bool_or(y = 1995) THEN 'first' ELSE 'second' END AS state FROM (SELECT o_custkey AS k, year(o_orderdate) AS y FROM orders WHERE year(o_orderdate) IN (1995, 1996)) GROUP BY k) GROUP BY 1")
def q7_07_set_relation(t):
    of = lambda y: t("orders").where(F.year("o_orderdate") == y).select(F.col("o_custkey").alias("k"))
    say = {"paired": "both", "orphan_left": "first", "orphan_right": "second"}
    s = O.pair_check(of(1995), of(1996), "k")
    return s.groupBy(F.create_map(*(F.lit(x) for kv in say.items() for x in kv))[F.col("state")].alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT run, count(*) AS n, count(o_orderpriority) AS with_priority FROM (SELECT 'a' AS run, o_orderkey, o_orderpriority FROM orders UNION ALL SELECT 'b', o_orderkey, NULL FROM orders) GROUP BY 1")
def q7_08_union_runs(t):
    a = t("orders").select(F.lit("a").alias("run"), "o_orderkey", "o_orderpriority").unionByName(t("orders").select(F.lit("b").alias("run"), "o_orderkey"), True)
    return a.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.count("o_orderpriority").alias("with_priority"))


@query("SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def q8_01_hash_duplicates(t):
    return O.hash_duplicates(t("documents"), "text", "doc_id")


@query("SELECT sha256(text) AS hash, count(*) AS n, CASE WHEN least(count(DISTINCT lang), count(DISTINCT source)) = 0 THEN 'unverifiable' WHEN greatest(count(DISTINCT lang), count(DISTINCT source)) > 1 THEN 'stale' ELSE 'identical' END AS verdict FROM documents GROUP BY 1 HAVING count(*) > 1")
def q8_02_classify_duplicates(t):
    return O.classify_duplicates(t("documents"), "text", ["lang", "source"])


@query("SELECT conv_id, sha256(role) AS hash, count(*) AS n FROM conversations GROUP BY 1, 2 HAVING count(*) > 1")
def q8_03_within_duplicates(t):
    return t("conversations").groupBy("conv_id", F.sha2("role", 256).alias("hash")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("SELECT regexp_extract(url, '://([^/]+)', 1) AS host, count(*) AS n_files, CAST(sum(length(html)) AS BIGINT) AS bytes, bool_or(contains(url, '?')) AS has_query FROM pages GROUP BY 1")
def q8_06_signature(t):
    return t("pages").groupBy(F.regexp_extract("url", "://([^/]+)", 1).alias("host")).agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.length("html")).alias("bytes"), F.bool_or(F.col("url").contains("?")).alias("has_query"))


@query("""SELECT k, coalesce(nullif(concat_ws('|', CASE WHEN n2 IS NULL THEN 'MISSING' END, CASE WHEN n1 IS NULL THEN 'EXTRA' END, CASE WHEN n1 <> n2 THEN 'FILE_COUNT' END, CASE WHEN abs(t1 - t2) > 0.005 THEN 'TOTAL_BYTES' END,
  CASE WHEN n1 IS NOT NULL AND n2 IS NOT NULL AND d1 <> d2 THEN 'SHA256' END, CASE WHEN c1 AND n2 IS NOT NULL AND NOT c2 THEN 'LICENSE_FILE_LOST' END, CASE WHEN n1 IS NOT NULL AND k IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') THEN 'SOURCE_STILL_EXISTS' END), ''), 'OK') AS issue
FROM (SELECT l_orderkey AS k, count(*) AS n1, sum(l_quantity) AS t1, string_agg(h, '' ORDER BY h) AS d1, bool_or(l_linenumber = 7) AS c1 FROM (SELECT *, sha256(CAST(l_partkey AS VARCHAR)) AS h FROM lineitem) WHERE l_quantity > 5 GROUP BY 1)
FULL JOIN (SELECT l_orderkey AS k, count(*) AS n2, sum(l_quantity) AS t2, string_agg(h, '' ORDER BY h) AS d2, bool_or(l_linenumber = 7) AS c2 FROM (SELECT *, sha256(CAST(l_partkey AS VARCHAR)) AS h FROM lineitem) WHERE l_linestatus <> 'F' GROUP BY 1) USING (k)""")
def q8_07_verify_ledger(t):
    """A move has few files, so their hashes are put in order."""

    def of(rows):
        g = t("lineitem").where(rows).groupBy(F.col("l_orderkey").alias("k"))
        hashes = F.sort_array(F.collect_list(F.sha2(F.col("l_partkey").cast("string"), 256)))
        return g.agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("total"), F.sha2(F.array_join(hashes, ""), 256).alias("digest"), F.bool_or(F.col("l_linenumber") == 7).alias("license"))

    left = t("orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("k"))
    return O.verify_ledger(of("l_quantity > 5"), of("l_linestatus <> 'F'"), "k", left)


@query("SELECT o_custkey, count(*) AS n, CASE WHEN bool_and(o_orderstatus = 'F') THEN 'complete' WHEN bool_and(o_orderstatus <> 'F') THEN 'rolled_back' ELSE 'partial' END AS state FROM orders GROUP BY 1")
def q8_10_ledger_state(t):
    f = F.col("o_orderstatus") == "F"
    return t("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.when(F.bool_and(f), "complete").when(F.bool_and(~f), "rolled_back").otherwise("partial").alias("state"))


@query("SELECT max(k) AS last_done, max(k) + 1 AS next FROM (SELECT o_orderkey AS k FROM orders UNION ALL SELECT l_orderkey FROM lineitem)")
def q8_13_resume(t):
    k = t("orders").select(F.col("o_orderkey").alias("k")).union(t("lineitem").select("l_orderkey"))
    return k.agg(F.max("k").alias("last_done"), (F.max("k") + 1).alias("next"))


@query("SELECT p_brand, count(*) AS n, round(avg(abs(a - p_retailprice)), 4) AS mae, round(quantile_cont(abs(a - p_retailprice), 0.5), 4) AS median_ae, round(quantile_cont(abs(a - p_retailprice), 0.9), 4) AS q90, round(quantile_cont(abs(a - p_retailprice), 0.95), 4) AS q95, round(corr(p_retailprice, a), 4) AS pearson, round(corr(r1, r2), 4) AS spearman, round(avg(a - p_retailprice), 4) AS bias FROM (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2.0::DOUBLE AS r1, rank() OVER (PARTITION BY p_brand ORDER BY a) + (count(*) OVER (PARTITION BY p_brand, a) - 1) / 2.0::DOUBLE AS r2 FROM (SELECT p_brand, p_retailprice, l_extendedprice / l_quantity AS a FROM lineitem JOIN part ON l_partkey = p_partkey)) GROUP BY 1")
def q9_01_agreement(t):
    j = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select("p_brand", "p_retailprice", (F.col("l_extendedprice") / F.col("l_quantity")).alias("a"))
    return rounded(O.agreement(j, "p_retailprice", "a", "p_brand"), 4)


@query("SELECT CAST(count(*) FILTER (WHERE l_tax = 0) AS BIGINT) AS n_zero, count(*) FILTER (WHERE l_tax > 0) AS n_positive, round(count(*) FILTER (WHERE l_tax = 0) / count(l_tax), 6) AS p_zero, round(avg(l_tax) FILTER (WHERE l_tax > 0), 6) AS positive_mean, round(quantile_cont(l_tax, 0.5) FILTER (WHERE l_tax > 0), 6) AS positive_median, CAST(count(*) FILTER (WHERE l_tax IS NULL) AS BIGINT) AS n_missing FROM lineitem")
def q9_02_zero_inflated(t):
    return rounded(O.zero_inflated(t("lineitem"), "l_tax"))


@query("SELECT n, round(greatest(0.9 * least(sd, (q3 - q1) / 1.349) * pow(n, -0.2), 0.02 * span), 6) AS bandwidth FROM (SELECT count(*) AS n, stddev_samp(l_quantity) AS sd, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.75) AS q3, max(l_quantity) - min(l_quantity) AS span FROM lineitem)")
def q9_04_silverman(t):
    return rounded(O.silverman(t("lineitem"), "l_quantity"))


@query("SELECT round(g, 6) AS grid, round(sum(m * (exp(-0.5 * ((g - x) / 2) ** 2) + exp(-0.5 * ((g + x) / 2) ** 2) + exp(-0.5 * ((g - 110 + x) / 2) ** 2))) / (sum(m) * 2 * sqrt(2 * pi())), 6) AS density FROM (SELECT l_quantity AS x, count(*) AS m FROM lineitem GROUP BY 1), (SELECT 55.0::DOUBLE * i / 63 AS g FROM range(64) AS r(i)) GROUP BY g")
def q9_05_kde(t):
    return rounded(O.kde(t("lineitem"), "l_quantity", 0.0, 55.0, 64, 2.0))


@query("SELECT variable, value, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY variable), 6) AS fraction, value IS NULL AS is_missing FROM (SELECT 'l_returnflag' AS variable, l_returnflag AS value FROM lineitem UNION ALL SELECT 'l_linestatus', l_linestatus FROM lineitem UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR) FROM lineitem) GROUP BY 1, 2")
def q9_11_discrete(t):
    return rounded(O.discrete_counts(t("lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"]))


@query("SELECT p_type, CAST(b AS BIGINT) + CASE WHEN row_number() OVER (ORDER BY round(x - b, 9) DESC, p_type) <= 1000 - sum(b) OVER () THEN 1 ELSE 0 END AS quota FROM (SELECT p_type, x, floor(x) AS b FROM (SELECT p_type, count(*) * 1000 / sum(count(*)) OVER () AS x FROM part GROUP BY 1))")
def q10_01_apportion(t):
    return O.apportion(t("part"), "p_type", 1000)


@query("SELECT p_partkey, p_type FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY md5(CAST(p_partkey AS VARCHAR)), p_partkey) AS r FROM part) WHERE r <= 5")
def q10_03_quota_select(t):
    return O.quota_select(t("part").select("p_partkey", "p_type"), "p_type", "p_partkey", 5)


@query("SELECT p_partkey, p_type, p_size FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY -ln(('0x' || substr(md5(concat_ws('|', CAST(p_partkey AS VARCHAR), '7')), 1, 8))::BIGINT / 4294967296.0::DOUBLE + pow(2, -33)) / (p_size + 1), p_partkey) AS r FROM part) WHERE r <= 5")
def q10_05_weighted_sample(t):
    return O.weighted_sample(t("part").select("p_partkey", "p_type", "p_size"), "p_type", "p_partkey", F.col("p_size") + 1, 5, 7)


@query("SELECT CASE WHEN u < 0.6 THEN 'mild' WHEN u < 0.9 THEN 'medium' ELSE 'strong' END AS tier, count(*) AS n FROM (SELECT ('0x' || substr(md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), '11')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM orders) GROUP BY 1")
def q10_06_tier_draw(t):
    u = D.hashed_uniform(F.col("o_orderkey"), F.lit(11))
    tier = F.when(u < 0.6, "mild").when(u < 0.9, "medium").otherwise("strong")
    return t("orders").groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, sha256('42|' || CAST(o_orderkey AS VARCHAR) || '|0') AS seed FROM orders")
def q10_07_frame_seed(t):
    return t("orders").select("o_orderkey", F.sha2(F.concat(F.lit("42|"), F.col("o_orderkey").cast("string"), F.lit("|0")), 256).alias("seed"))
