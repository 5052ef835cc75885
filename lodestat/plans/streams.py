"""Queries that run streaming jobs over the events table until all of it is read."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestat.plans.registry import stream_query
from lodestat.storage import materialize, new_path
from lodestat.streaming import jobs, stateful


def _folder(spark: SparkSession) -> str:
    return new_path(spark, "stream")


def saver(spark: SparkSession):
    """Writes a table to a new folder and reads it back, which cuts its lineage."""
    return materialize


def _events(spark: SparkSession, d: str, *columns: str):
    """A file stream takes a single file only by a pattern."""
    return jobs.records(spark, f"{d}/events.parque[t]").select(*columns)


@stream_query("SELECT event_id, user_id, value, value >= 50 AS accepted FROM events WHERE value IS NOT NULL")
def q12_01_split_records(spark, d):
    yes, no = jobs.split_records(_events(spark, d, "event_id", "user_id", "value").where("value is not null"), F.col("value") >= 50, _folder(spark))
    return yes.withColumn("accepted", F.lit(True)).unionByName(no.withColumn("accepted", F.lit(False)))


@stream_query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def q12_02_counters(spark, d):
    return jobs.counters(_events(spark, d, "event_type"), ["event_type"], _folder(spark))


@stream_query("SELECT DISTINCT user_id, event_type FROM events")
def q12_03_first_seen(spark, d):
    return jobs.first_seen(_events(spark, d, "user_id", "event_type"), ["user_id", "event_type"], _folder(spark))


@stream_query("SELECT user_id, ts, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def q12_04_latest(spark, d):
    return jobs.latest(_events(spark, d, "user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], _folder(spark))


@stream_query("SELECT epoch(h)::BIGINT AS start_s, n FROM (SELECT date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY 1) WHERE h + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events)")
def q12_05_throughput(spark, d):
    return jobs.throughput(_events(spark, d, "ts").withColumn("ts", F.col("ts").cast("timestamp")), "ts", _folder(spark)).select(F.unix_timestamp("start").alias("start_s"), "n")


def _in_two_runs(spark, d, folder, job):
    """Events as two files, the second of which comes after the job has read the first and ended; the job is started again for it."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "event_type", "value")
    half = e.agg(F.percentile_approx("event_id", 0.5)).first()[0]  # once: a second look may find another number
    early = F.coalesce(F.col("event_id") <= F.lit(half), F.lit(False))
    for part in (early, ~early):
        e.where(part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        out = job(jobs.records(spark, f"{folder}/in"))
    return out


@stream_query("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) > 1 AS is_repeat FROM events WHERE user_id IS NOT NULL")
def q12_03_flagged_repeats(spark, d):
    """Repeats are kept and flagged, over a restart."""
    folder = _folder(spark)
    job = lambda s: stateful.flag_repeats(s.where("user_id is not null"), ["user_id", "event_type"], ["event_id"], folder)
    return _in_two_runs(spark, d, folder, job).select("event_id", "is_repeat")


@stream_query(
    "WITH e AS (SELECT event_type, row_number() OVER w AS a, sum((coalesce(value, 0) >= 12)::INT) OVER w AS d FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)), "
    "s AS (SELECT event_type, min(a) FILTER (d = 500) AS hit, max(a) AS n FROM e GROUP BY 1), x AS (SELECT event_type, least(coalesce(hit, n), n, 1600) AS a, hit FROM s) "
    "SELECT x.event_type AS run, x.a AS attempts, CAST(e.d AS BIGINT) AS delivered, CASE WHEN x.hit <= 1600 THEN 'complete' WHEN x.a = 1600 THEN 'cap_hit' ELSE 'incomplete' END AS status FROM x JOIN e ON e.event_type = x.event_type AND e.a = x.a"
)
def q12_06_stream_completion(spark, d):
    """Runs by event type that end at 500 usable rows or 1600 attempts, over a restart."""
    folder = _folder(spark)
    return _in_two_runs(spark, d, folder, lambda s: stateful.complete_runs(s.withColumn("ok", F.col("value") >= 12), "event_type", "event_id", "ok", 500, 1600, folder))
