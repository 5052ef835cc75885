
from __future__ import annotations

from pyspark.sql import functions as F

from lodestat.functions import scalars as S
from lodestat.operators import audits as A
from lodestat.plans.registry import query, rounded

c = F.col

# duplicates by stage: documents as masks, the language as their stage, the first letters as their content

_MASKS = """WITH m AS (SELECT doc_id, lang, CASE WHEN n_chars < 60 THEN 0 ELSE n_chars END AS area, CASE WHEN n_chars < 60 THEN '__all_black__' ELSE substr(text, 1, 4) END AS key, sha256(text) AS file, substr(text, 1, 6) AS s1, CASE WHEN source <> 'src1' THEN length(source) END AS s2 FROM documents WHERE text IS NOT NULL),
g AS (SELECT lang, key, count(*) AS n, count(DISTINCT file) = 1 AS byte_identical, CASE WHEN key = '__all_black__' AND lang = 'en' THEN 'empty_target' WHEN key = '__all_black__' THEN 'all_black'
  WHEN count(DISTINCT s1) > 1 OR count(DISTINCT s2) > 1 THEN 'stale_or_mismatched' WHEN count(s2) < count(*) THEN 'unverifiable' ELSE 'identical_geometry' END AS class FROM m GROUP BY 1, 2 HAVING count(*) > 1) """


def _masks(t):
    d = t("documents").where("text is not null")
    return d.select("doc_id", "lang", F.when(c("n_chars") < 60, 0).otherwise(c("n_chars")).alias("area"), F.substring("text", 1, 4).alias("content"), F.sha2("text", 256).alias("file"), F.substring("text", 1, 6).alias("s1"), F.when(c("source") != "src1", F.length("source")).alias("s2"))


def _groups(t):
    return A.stage_duplicates(_masks(t), "lang", "content", "area", "file", ["s1", "s2"], "en")


@query(_MASKS + "SELECT * FROM g")
def q8_02_stage_duplicates(t):
    return _groups(t)


@query(_MASKS + "SELECT doc_id, coalesce(string_agg(DISTINCT CASE WHEN class IS NOT NULL THEN lang END, ';'), '') AS stages, coalesce(string_agg(DISTINCT class, ';'), '') AS classes, coalesce(string_agg(DISTINCT CASE class WHEN 'stale_or_mismatched' THEN 'mask_stale_cross_frame_duplicate' WHEN 'unverifiable' THEN 'mask_duplicate_geometry_unverifiable' END, ';'), '') AS failures FROM m LEFT JOIN g USING (lang, key) GROUP BY 1")
def q8_02_fold_back(t):
    return A.fold_duplicates(_masks(t), "doc_id", "lang", "content", "area", _groups(t))


@query("SELECT conv_id, string_agg(CAST(turn AS VARCHAR), '|' ORDER BY turn) AS stages, CASE WHEN count(s) < count(*) THEN 'unverifiable' WHEN min(s) <> max(s) THEN 'stale' ELSE 'expected' END AS verdict FROM (SELECT *, CASE WHEN length(text) >= 50 THEN length(text) > 300 END AS s FROM conversations) GROUP BY conv_id, role HAVING count(*) > 1")
def q8_03_within_verdict(t):
    state = F.when(F.length("text") >= 50, F.length("text") > 300)
    return A.within_duplicates(t("conversations").withColumn("s", state), "conv_id", "turn", "role", "s")


@query(
    "WITH p AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS top, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, strlen(html) AS b, contains(url, '?') AS q FROM pages), e AS (SELECT *, CASE WHEN contains(regexp_extract(path, '([^/]*)$', 1), '.') THEN lower(regexp_extract(path, '([^./]*)$', 1)) ELSE '' END AS ext FROM p), "
    "x AS (SELECT top, string_agg(ext || ':' || n, ',' ORDER BY ext) AS extensions FROM (SELECT top, ext, count(*) AS n FROM e GROUP BY 1, 2) GROUP BY 1) "
    "SELECT top, count(*) AS files, CAST(sum(b) AS BIGINT) AS bytes, min(page_id) AS first, max(page_id) AS last, any_value(extensions) AS extensions, bool_or(coalesce(q, false)) AS has_query FROM e JOIN x USING (top) GROUP BY 1"
)
def q8_06_dir_signature(t):
    p = t("pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("top"), F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1).alias("path"), F.octet_length("html").cast("bigint").alias("b"), c("url").contains("?").alias("q"))
    return A.dir_signature(p, c("top"), "path", "b", "page_id", {"has_query": c("q")})


@query(
    "WITH f AS (SELECT string_split('a' || p_size || '/b' || (p_partkey % 7) || '/' || p_type || '/' || p_partkey || '.bin', '/') AS x FROM part), d AS (SELECT DISTINCT array_to_string(x[1:i], '/') AS leaked, i < 4 AS dir FROM f, range(1, 5) r(i)), "
    "e AS (SELECT 'a' || n_nationkey || '/b' || n_regionkey AS entry FROM nation UNION SELECT 'old/' || n_name FROM nation UNION SELECT 'x/PROMO'), n AS (SELECT entry, string_split(entry, '/')[-1] AS name FROM e) "
    "SELECT entry, leaked, 'path' AS how FROM d JOIN n ON leaked = entry UNION ALL SELECT entry, leaked, 'name' FROM d JOIN n ON dir AND string_split(leaked, '/')[-1] = name AND leaked <> entry"
)
def q8_11_release_leaks(t):
    release = t("part").select(F.concat_ws("/", F.concat(F.lit("a"), "p_size"), F.concat(F.lit("b"), c("p_partkey") % 7), "p_type", F.concat(c("p_partkey").cast("string"), F.lit(".bin"))).alias("path"))
    n = t("nation")
    entries = n.select(F.concat(F.lit("a"), "n_nationkey", F.lit("/b"), "n_regionkey").alias("path")).union(n.select(F.concat(F.lit("old\\"), "n_name", F.lit("/")))).union(n.limit(1).select(F.lit("x/PROMO")))
    return A.release_leaks(entries, release, "path")


# shares, quotas, decisions


@query("WITH g AS (SELECT DISTINCT p_type, cell, CASE WHEN cell < 4 THEN 0.25::DOUBLE / (SELECT count(DISTINCT p_type) FROM part) ELSE 0 END AS want FROM part, range(0, 5) r(cell)), n AS (SELECT p_type, least(p_size // 10, 4) AS cell, count(*) FILTER (length(p_name) > 9) AS n, count(*) AS tried FROM part GROUP BY 1, 2) SELECT p_type, cell, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT sum(n) FROM n), 6) AS share, CASE WHEN want > 0 THEN round(coalesce(n, 0) / (SELECT sum(n) FROM n) / want, 6) END AS ratio, round((tried - n) / tried, 6) AS reject_rate FROM g LEFT JOIN n USING (p_type, cell)")
def q4_20_cell_rates(t):
    p = t("part").withColumn("cell", F.least(F.floor(c("p_size") / 10), F.lit(4)).cast("bigint"))
    types = p.select("p_type").distinct()
    n = types.agg(F.count(F.lit(1)).alias("k"))
    want = types.join(F.broadcast(n)).select("p_type", F.explode(F.array(*(F.lit(i).cast("bigint") for i in range(5)))).alias("cell"), "k").select("p_type", "cell", F.when(c("cell") < 4, 0.25 / c("k")).otherwise(0.0).alias("want"))
    return rounded(A.cell_rates(p, "p_type", "cell", F.length("p_name") > 9, want))


@query("SELECT bin, string_agg(r || ':' || n, ',' ORDER BY n DESC, r) AS reasons FROM (SELECT CAST(floor(l_quantity / 10) AS BIGINT) AS bin, CASE WHEN l_tax > 0.06 THEN 'tax' WHEN l_discount > 0.08 THEN 'discount' WHEN l_returnflag = 'R' THEN 'returned' END AS r, count(*) AS n FROM lineitem GROUP BY 1, 2) WHERE r IS NOT NULL GROUP BY 1")
def q4_21_reasons(t):
    reason = F.when(c("l_tax") > 0.06, "tax").when(c("l_discount") > 0.08, "discount").when(c("l_returnflag") == "R", "returned")
    return A.reason_lists(t("lineitem").withColumn("r", reason), F.floor(c("l_quantity") / 10), "r")


@query("WITH n AS (SELECT p_type AS key, count(*) AS n FROM part WHERE p_size > 25 AND length(p_name) > 9 GROUP BY 1), w AS (SELECT DISTINCT p_type AS key, 1.0::DOUBLE / (SELECT count(DISTINCT p_type) FROM part) AS prescribed FROM part), e AS (SELECT key, prescribed, coalesce(n, 0) / (SELECT sum(n) FROM n) AS f FROM w LEFT JOIN n USING (key)) SELECT key, round(prescribed, 6) AS prescribed, round(f, 6) AS accepted_frac, round(abs(f - prescribed), 6) AS abs_error, abs(f - prescribed) <= 0.02 AS ok, abs(f - prescribed) = max(abs(f - prescribed)) OVER () AS worst FROM e")
def q4_16_given_marginals(t):
    types = t("part").select(c("p_type").alias("key")).distinct()
    want = types.join(F.broadcast(types.agg(F.count(F.lit(1)).alias("k")))).select("key", (F.lit(1.0) / c("k")).alias("prescribed"))
    return rounded(A.given_marginals(t("part"), "p_type", c("p_size") > 25, want, F.length("p_name") > 9))


@query(
    "WITH r AS (SELECT year(l_shipdate) AS config, l_suppkey AS k, max(l_quantity) > 40 AS yes, min(l_tax) AS e, round(sum(l_extendedprice), 2) AS cost FROM lineitem GROUP BY 1, 2), p AS (SELECT s_suppkey AS k FROM supplier WHERE s_acctbal > 9000), "
    "g AS (SELECT config, count(*) FILTER (yes) AS n_accepted, round(sum(cost), 2) AS cost, quantile_cont(e, 0.5) FILTER (yes) AS median, quantile_cont(e, 0.95) FILTER (yes) AS p95 FROM r GROUP BY 1), "
    "l AS (SELECT g.config, string_agg(CAST(p.k AS VARCHAR), '|' ORDER BY p.k) AS lost FROM g, p WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.config = g.config AND r.k = p.k AND r.yes) GROUP BY 1), "
    "q AS (SELECT g.*, coalesce(lost, '') AS lost, coalesce(g.median <= b.median + 0.01, true) AND coalesce(g.p95 <= b.p95 + 0.02, true) AS quality FROM g LEFT JOIN l USING (config), (SELECT * FROM g WHERE config = 1995) b), "
    "s AS (SELECT *, lost = '' AND quality AND config <> 1995 AS eligible FROM q) SELECT config, n_accepted, cost, round(median, 6) AS median, round(p95, 6) AS p95, lost, quality, eligible, eligible AND row_number() OVER (PARTITION BY eligible ORDER BY cost, config) = 1 AS winner FROM s"
)
def q4_30_decision(t):
    runs = t("lineitem").groupBy(F.year("l_shipdate").alias("config"), c("l_suppkey").alias("case")).agg((F.max("l_quantity") > 40).alias("accepted"), F.min("l_tax").alias("error"), F.round(F.sum("l_extendedprice"), 2).alias("cost"))
    out = A.config_decision(runs, t("supplier").where("s_acctbal > 9000").select(c("s_suppkey").alias("case")), 1995)
    return rounded(out.withColumn("cost", F.round("cost", 2)))


@query("WITH w AS (SELECT p_type, 20 * row_number() OVER (ORDER BY p_type) + 200 AS quota FROM (SELECT DISTINCT p_type FROM part) UNION ALL SELECT 'NONE', 7), n AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1) SELECT p_type, quota, coalesce(n, 0) AS candidates, least(quota, coalesce(n, 0)) AS accepted, greatest(quota - coalesce(n, 0), 0) AS deficit, greatest(coalesce(n, 0) - quota, 0) AS overflow FROM w LEFT JOIN n USING (p_type)")
def q10_03_quota_report(t):
    from pyspark.sql import Window

    types = t("part").select("p_type").distinct()  # a short list of labels
    quotas = types.select("p_type", (20 * F.row_number().over(Window.partitionBy().orderBy("p_type")) + 200).cast("bigint").alias("quota"))
    none = types.limit(1).select(F.lit("NONE").alias("p_type"), F.lit(7).cast("bigint").alias("quota"))
    return A.quota_report(t("part"), "p_type", quotas.union(none))


_FILL = "WITH p AS (SELECT o_orderkey, o_totalprice AS x, o_custkey < 10 AS g, concat_ws('|', CASE WHEN o_custkey < 10 THEN 'protected' END, CASE WHEN o_totalprice > {dear} THEN 'dear' END, CASE WHEN o_orderstatus = 'P' AND o_custkey < 30 THEN 'partial' END) AS r FROM orders), k AS (SELECT o_orderkey, r AS reasons FROM p WHERE r <> '' ORDER BY g DESC, o_orderkey LIMIT {cap}), f AS (SELECT o_orderkey, row_number() OVER (ORDER BY x DESC, o_orderkey) AS i FROM p WHERE r = '') SELECT o_orderkey, reasons FROM k UNION ALL SELECT o_orderkey, 'cost_fill' FROM f WHERE i <= greatest({least} - (SELECT count(*) FROM k), 0)"


def _fill(t, dear, cap, least):
    rules = {"dear": c("o_totalprice") > dear, "partial": (c("o_orderstatus") == "P") & (c("o_custkey") < 30)}
    return A.fill_subset(t("orders"), "o_orderkey", rules, c("o_custkey") < 10, "o_totalprice", cap, least)


@query(_FILL.format(dear=400000, cap=50, least=20))
def q6_04_capped_subset(t):
    """Protected rows first, over the cap."""
    return _fill(t, 400000, 50, 20)


@query(_FILL.format(dear=10000000, cap=2000, least=500))
def q6_04_filled_subset(t):
    """Under the least number, filled up by cost."""
    return _fill(t, 10000000, 2000, 500)


@query("WITH u AS (SELECT unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT * FROM (SELECT 'labelled' AS statistic, round(avg((label > 3)::INT), 6) AS value FROM embeddings UNION ALL SELECT 'distinct_label', count(DISTINCT label)::DOUBLE FROM embeddings UNION ALL SELECT 'p99_embedding', round(quantile_cont(v, 0.99), 6) FROM u UNION ALL SELECT 'median_id', round(quantile_cont(vec_id, 0.5), 6) FROM embeddings)")
def q4_36_wide_stats(t):
    return rounded(A.wide_stats(t("embeddings"), {"labelled": c("label") > 3}, ["label"], {"embedding": c("embedding")}, {"median_id": ("vec_id", 0.5)}))


# labels and probes


@query("WITH p AS (SELECT *, abs(l_quantity - lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)) AS d FROM lineitem) SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag <> 'N') AS kind_failures, max(d) AS max_step, round(min(0.07 - l_discount), 6) AS edge_margin, coalesce(count(*) = 4 AND count(*) FILTER (l_returnflag <> 'N') = 0 AND max(d) <= 30 AND min(round(0.07 - l_discount, 6)) >= 0, false) AS ok FROM p GROUP BY 1")
def q5_03_probe_verdict(t):
    rows = t("lineitem").withColumn("edge", F.round(0.07 - c("l_discount"), 6))
    return rounded(A.probe_verdict(rows, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], "l_quantity", "l_returnflag", "N", "edge", 30, 4))


@query("SELECT p_partkey, concat_ws('|', CASE WHEN p_retailprice / 2000 < 0.5 THEN 'LOW_VISIBILITY' END, CASE WHEN p_size % 9 <> 8 THEN 'CUBOID_LENGTH' END) AS issues FROM part")
def q3_02_label_issues(t):
    p = t("part").withColumn("visibility", c("p_retailprice") / 2000)
    corners = F.array_repeat(F.lit(0), (c("p_size") % 9).cast("int"))
    return A.label_issues(p, "visibility", corners).select("p_partkey", "issues")


@query("SELECT l_orderkey, l_linenumber, l_partkey, (l_quantity > 25)::BIGINT + 2 * (l_tax = 0)::BIGINT + 4 * (l_returnflag = 'N')::BIGINT + 8 * (l_discount > 0.05)::BIGINT AS mask FROM lineitem")
def q2_18_bitmask(t):
    flags = F.array(c("l_quantity") > 25, c("l_tax") == 0, c("l_returnflag") == "N", c("l_discount") > 0.05)
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", A.bitmask(flags).alias("mask"))


@query("SELECT event_id, CASE event_id % 8 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN value <> 0 END AS wide, CASE event_id % 8 WHEN 2 THEN true WHEN 3 THEN false END AS strict FROM events")
def q2_03_bool(t):
    texts = ["yes", " No ", "TRUE", "false", None, "x", "", "nan"]
    text = F.coalesce(*(F.when(c("event_id") % 8 == i, F.lit(x) if x is not None else c("value").cast("string")) for i, x in enumerate(texts)))
    return t("events").select("event_id", S.as_bool(text).alias("wide"), S.as_bool(text, "strict").alias("strict"))


@query(
    """WITH s AS (SELECT s_suppkey, '"geo":{"acct":"' || printf('%.9f', s_acctbal) || '","tags":{"a":"' || printf('%.9f', s_acctbal / 2) || '"}}' AS geo, '"name":"' || s_name || '"' AS name, '"points":[{"k":' || s_nationkey || '},{"k":1}]' AS points FROM supplier)
SELECT s_suppkey, sha256('{' || geo || '}') AS sha_plan, sha256('{' || name || ',' || points || '}') AS sha_spec, sha256('{' || geo || ',' || name || ',' || points || '}') AS sha FROM s"""
)
def q7_04_nested_sha(t):
    half = c("s_acctbal") / 2
    s = t("supplier").select(
        "s_suppkey", F.concat(F.lit("data/"), "s_name").alias("name"), F.array(F.struct(c("s_nationkey").alias("k"), F.rand(1).alias("noise")), F.struct(F.lit(1).alias("k"), F.rand(2).alias("noise"))).alias("points"),
        F.struct(F.create_map(F.lit("noise"), half, F.lit("a"), half).alias("tags"), c("s_acctbal").alias("acct")).alias("geo"),
    )
    return A.nested_sha(s, "s_suppkey", {"plan": ["geo"], "spec": ["name", "points"]}, ("noise",), ("name",))
