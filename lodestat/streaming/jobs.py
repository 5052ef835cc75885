"""Structured Streaming jobs over record logs: ingest with resume, live counters, first-seen gate, latest snapshot, windowed throughput.

Each job runs what is there (availableNow) and ends; started again with the same folder, it goes on where it stopped, for offsets and
state are in the checkpoint below that folder. Folders must be shared by driver and executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def records(spark: SparkSession, path: str, schema: str | None = None, files_per_batch: int = 1000) -> DataFrame:
    """A stream of the Parquet files at path (a file, a folder or a glob); the schema is that of the files unless given."""
    kind = schema or spark.read.parquet(path).schema
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _run(df: DataFrame, folder: str, mode: str, each: Callable[[DataFrame, int], None]) -> None:
    query = df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at path, None if there is none; any other fault is raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _batches(spark: SparkSession, path: str, schema) -> DataFrame:
    found = stored(spark, path)
    return (found if found is not None else spark.createDataFrame([], schema)).drop("batch").select(*schema.names)


def _write(df: DataFrame, path: str, batch: int) -> None:
    """A batch that is repeated after a failure replaces what it wrote before."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def split_records(stream: DataFrame, accepted: Column, folder: str) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected records; a null condition rejects. Both sinks are written in one pass over each batch."""

    def each(df: DataFrame, batch: int) -> None:
        marked = df.withColumn("accepted", F.coalesce(accepted, F.lit(False)))
        marked.write.mode("overwrite").partitionBy("accepted").parquet(f"{folder}/log/batch={batch}")

    _run(stream, folder, "append", each)
    log = stored(stream.sparkSession, f"{folder}/log")
    if log is None:
        empty = stream.sparkSession.createDataFrame([], stream.schema)
        return empty, empty
    return tuple(log.where(F.col("accepted").cast("string") == x).select(*stream.columns) for x in ("true", "false"))


def counters(stream: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """Number of records by keys so far; state has a row for each key. The newest batch's table is returned."""
    counts = stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    _run(counts, folder, "complete", lambda df, batch: _write(df, f"{folder}/counts", batch))
    found = stored(stream.sparkSession, f"{folder}/counts")
    if found is None:
        return stream.sparkSession.createDataFrame([], counts.schema)
    newest = found.agg(F.max("batch")).first()[0]
    return found.where(F.col("batch") == newest).select(*counts.columns)


def first_seen(stream: DataFrame, keys: list[str], folder: str, event_time: str | None = None, within: str | None = None) -> DataFrame:
    """The first record of each key. With event_time and within, keys are forgotten once the watermark has passed them, so state stays bounded;
    without, state has a row for each key there ever was."""
    once = stream.withWatermark(event_time, within).dropDuplicatesWithinWatermark(keys) if event_time and within else stream.dropDuplicates(keys)
    _run(once, folder, "append", lambda df, batch: _write(df, f"{folder}/first", batch))
    return _batches(stream.sparkSession, f"{folder}/first", stream.schema)


def latest(stream: DataFrame, keys: list[str], order: list[str], folder: str, buckets: int = 64) -> DataFrame:
    """The latest record of each key by order.

    The snapshot lies in buckets by a hash of the keys. A manifest for each batch names the version of every bucket; a batch reads and
    writes only the buckets that its records fall into, and the rest keep their version. A batch that is repeated starts from the manifest
    before it. If that is gone, the job fails rather than begin anew.
    """
    spark, value = stream.sparkSession, F.struct(*order, *(c for c in stream.columns if c not in {*keys, *order}))

    def each(df: DataFrame, batch: int) -> None:
        own = df.sparkSession
        rows = df.select(*stream.columns, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket"))
        touched = sorted(r.bucket for r in rows.select("bucket").distinct().collect())  # at most `buckets`
        before = {r.bucket: r.version for r in own.read.parquet(f"{folder}/manifest/batch={batch - 1}").collect()} if batch else {}
        paths = [f"{folder}/data/version={before[b]}/bucket={b}" for b in touched if b in before]
        if paths:
            old = own.read.option("basePath", f"{folder}/data").parquet(*paths).select(*rows.columns)
            rows = rows.unionByName(old)
        top = rows.groupBy(*keys).agg(F.max(value).alias("x"), F.first("bucket").alias("bucket")).select(*keys, "x.*", "bucket")
        top.repartition(max(1, len(touched)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/data/version={batch}")
        now = sorted((before | {b: batch for b in touched}).items())
        own.createDataFrame(now, "bucket int, version bigint").coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/batch={batch}")

    _run(stream, folder, "append", each)
    return snapshot(spark, stream, folder)


def snapshot(spark: SparkSession, like: DataFrame, folder: str) -> DataFrame:
    """What the newest manifest of latest() names, with the columns of a table."""
    found = stored(spark, f"{folder}/manifest")
    newest = found.where(F.col("batch") == found.agg(F.max("batch")).first()[0]).collect() if found is not None else []  # a row a bucket
    if not newest:
        return spark.createDataFrame([], like.schema)
    paths = [f"{folder}/data/version={r.version}/bucket={r.bucket}" for r in newest]
    return spark.read.option("basePath", f"{folder}/data").parquet(*paths).select(*like.columns)


def throughput(stream: DataFrame, time: str, folder: str, width: str = "1 hour", delay: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Records of each window that the watermark has closed; a record later than delay behind the newest is dropped by Spark."""
    spans = F.window(time, width, slide) if slide else F.window(time, width)
    counts = stream.withWatermark(time, delay).groupBy(spans.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
    _run(counts, folder, "append", lambda df, batch: _write(df, f"{folder}/windows", batch))
    return _batches(stream.sparkSession, f"{folder}/windows", counts.schema)
