"""Queries that write files of the driver tables to a new folder and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestat.plans.registry import stream_query
from lodestat.plans.streams import _folder
from lodestat.sources import files


def _read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


@stream_query("SELECT CASE WHEN value > 90 THEN 'bad json' WHEN value IS NULL OR value < 5 THEN 'no integer key' ELSE 'record' END AS state, count(*) AS n, CAST(sum(CASE WHEN value > 90 OR value IS NULL OR value < 5 THEN 0 ELSE event_id END) AS BIGINT) AS keys FROM events GROUP BY 1")
def q1_01_record_files(spark, d):
    folder, e = _folder(spark), _read(spark, d, "events")
    named = F.format_string('{"%s": %d, "value": 1.5}', F.when(F.col("event_type") == "click", "frame_index").otherwise("idx"), "event_id")
    line = F.when(F.col("value") > 90, '{"idx": ').when(F.col("value").isNull() | (F.col("value") < 5), '{"idx": "x"}').otherwise(named)
    e.select(line.alias("value")).write.text(f"{folder}/log")
    e.select("event_id").limit(1).write.json(f"{folder}/old")
    records, errors, ignored = files.read_records(spark, folder, "idx string, frame_index string, value double", lines="*.txt")
    good = records.select(F.lit("record").alias("state"), "key").where(F.lit(not ignored.isEmpty()))
    both = good.unionByName(errors.select(F.col("reason").alias("state"), F.lit(0).cast("bigint").alias("key")))
    return both.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.sum("key").alias("keys"))


@stream_query("SELECT n_nationkey AS id, 'csv' AS kind, true AS has_bytes FROM nation")
def q1_04_artefact_files(spark, d):
    folder = _folder(spark)
    _read(spark, d, "nation").repartition(1).write.partitionBy("n_nationkey").csv(folder)
    return files.scan_artifacts(spark, folder, r"n_nationkey=(\d+)/part").select("id", "kind", (F.col("bytes") > 0).alias("has_bytes"))


@stream_query("SELECT coalesce(lang, '__HIVE_DEFAULT_PARTITION__') AS lang, count(*) AS n FROM (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '(?i)licen[sc]e|copyright') GROUP BY 1")
def q1_05_log_files(spark, d):
    folder = _folder(spark)
    _read(spark, d, "documents").select("lang", "text").write.partitionBy("lang").text(folder)
    lines = files.scan_logs(spark, folder, ["licen[sc]e", "copyright"])
    return lines.groupBy(F.regexp_extract("file", "lang=([^/]+)/", 1).alias("lang")).agg(F.count(F.lit(1)).alias("n"))


@stream_query("SELECT line_no, count(*) AS n, min(event_id) AS least FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS line_no FROM events WHERE event_type IS NOT NULL) JOIN events USING (event_id) WHERE value >= 90 GROUP BY 1")
def q1_05_log_lines(spark, d):
    """A log for each event type, in splits of 16 KB or more; the line numbers of events with a high value."""
    folder, e = _folder(spark), _read(spark, d, "events").where("event_type is not null")
    line = F.concat_ws(" ", "event_id", F.when(F.col("value") >= 90, "HIGH value").otherwise("value"), F.col("value").cast("string"))
    e.repartition("event_type").sortWithinPartitions("event_type", "event_id").select("event_type", line.alias("line")).write.partitionBy("event_type").text(folder)
    lines = files.scan_logs(_split_small(spark, folder), folder, ["high VALUE"])
    return lines.groupBy("line_no").agg(F.count(F.lit(1)).alias("n"), F.min(F.split("line", " ")[0].cast("bigint")).alias("least"))


def _split_small(spark, folder):
    """A session like this one that reads the files of folder in splits of 16 KB, or of as much more as makes them about 256 splits."""
    own = spark.newSession()
    for k in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(k, spark.conf.get(k))
    size = files.list_files(spark, folder, "part-*").agg(F.sum("length")).first()[0] or 0
    own.conf.set("spark.sql.files.maxPartitionBytes", str(max(16384, size // 256)))
    own.conf.set("spark.sql.files.openCostInBytes", "0")
    return own


@stream_query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3 DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def q1_02_latest_lines(spark, d):
    """Three logs of JSON lines in several splits each, without a sequence column; the last line of a user wins."""
    folder, e = _folder(spark), _read(spark, d, "events").withColumn("log", F.concat(F.lit("log"), (F.col("event_id") % 3).cast("string")))
    e.repartition("log").sortWithinPartitions("log", "event_id").select("log", F.to_json(F.struct("user_id", "event_id", "event_type")).alias("line")).write.partitionBy("log").text(folder)
    return files.latest_records(_split_small(spark, folder), folder, "user_id long, event_id long, event_type string", ["user_id"])


@stream_query("SELECT n_nationkey, n_name, try_cast(n_name AS BIGINT) AS as_number, n_regionkey FROM (SELECT n_nationkey, n_name, n_regionkey FROM nation)")
def q1_06_manifest_csv(spark, d):
    folder, n = _folder(spark), _read(spark, d, "nation")
    n.select(F.col("n_nationkey").alias(files.BOM + "n_nationkey"), "n_name", F.col("n_name").alias("as_number"), "n_regionkey").write.option("header", True).csv(folder)
    kinds = {k: "bigint" for k in ("n_nationkey", "as_number", "n_regionkey")}
    return files.read_manifest_csv(spark, folder, kinds)


@stream_query("SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice, CAST(NULL AS VARCHAR) AS note FROM orders")
def q1_07_table_sink(spark, d):
    folder = _folder(spark)
    files.write_table(_read(spark, d, "orders"), folder, {"o_orderkey": "bigint", "o_totalprice": "double", "note": "string"})
    return spark.read.parquet(folder).select("o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"), "note")


@stream_query("SELECT format('f{:08d}', o_orderkey) AS frame_id, o_orderpriority AS mode, o_custkey AS asset FROM orders WHERE o_orderstatus = 'F'")
def q1_08_manifest_sink(spark, d):
    folder = _folder(spark)
    out = files.delivered_manifest(_read(spark, d, "orders"), F.col("o_orderstatus") == "F", "o_orderkey", {"mode": F.col("o_orderpriority"), "asset": F.col("o_custkey")})
    files.write_table(out, folder, {"frame_id": "string", "asset": "bigint", "mode": "string"}, by=["mode"])
    return spark.read.parquet(folder).select("frame_id", "mode", "asset")
