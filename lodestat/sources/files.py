"""Readers and sinks for the files that runs leave behind: record logs, artefacts, text logs, manifests and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BOM = "﻿"


def list_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, length, modificationTime) of files below folder whose name fits; their content is never read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder).select("path", "length", "modificationTime")


def read_records(spark: SparkSession, folder: str, schema: str, keys: tuple[str, ...] = ("idx", "frame_index"), lines: str = "*.jsonl", arrays: str = "*.json") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, errors, ignored) of a folder of run records.

    JSONL files are preferred; where there is one, JSON files (an array of records each) are listed in ignored. Blank lines are skipped. A line that is
    no JSON object of the schema, or whose first key that is there is no integer, becomes a row of errors (line, reason) and stops nothing.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    if not list_files(spark, folder, lines).isEmpty():
        ignored = list_files(spark, folder, arrays).select("path")
        text = reader.option("pathGlobFilter", lines).text(folder)
    else:
        whole = reader.option("pathGlobFilter", arrays).text(folder, wholetext=True)
        text = whole.select(F.explode_outer(F.from_json("value", "array<string>")).alias("value"))
        ignored = list_files(spark, folder, arrays).select("path").limit(0)
    parsed = F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = text.where(F.trim("value") != "").select("value", parsed.alias("r"))
    key = F.coalesce(*(F.col(f"r.{k}").try_cast("bigint") for k in keys))
    reason = F.when(F.col("r").isNull() | F.col("r._corrupt").isNotNull(), "bad json").when(key.isNull(), "no integer key")
    rows = rows.withColumns({"key": key, "reason": reason})
    return rows.where("reason is null").select("key", "r.*").drop("_corrupt"), rows.where("reason is not null").select(F.col("value").alias("line"), "reason"), ignored


def scan_artifacts(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(id, kind, path, bytes, mtime) of files whose path has the pattern, whose first group is the id; kind is what follows the last dot."""
    files = list_files(spark, folder).withColumn("id", F.regexp_extract("path", pattern, 1).try_cast("bigint")).where("id is not null")
    return files.select("id", F.substring_index("path", ".", -1).alias("kind"), "path", F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime"))


#: The place of a line of a text file: its file, the start of its split, and the row's number in the scan's partition.
FILE, SPLIT, ROW = "_file", "_split", "_row"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """line with its place. A file of any size is read in splits; rows of a split follow one another in a partition."""
    text = spark.read.option("recursiveFileLookup", True).text(path)
    return text.select(F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(SPLIT), F.monotonically_increasing_id().alias(ROW), F.col("value").alias("line"))


def scan_logs(spark: SparkSession, path: str, patterns: list[str]) -> DataFrame:
    """(file, line_no, line) of lines that have one of the patterns, in any case. Lines are counted in each split, and the counts of a file's
    earlier splits are added, so a task holds no more than the hits of one split."""
    hit = F.col("line").rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))
    each = _lines(spark, path).groupBy(FILE, SPLIT).agg(F.count(F.lit(1)).alias("n"), F.min(ROW).alias("first"), F.collect_list(F.when(hit, F.struct(ROW, "line"))).alias("hits"))
    before = F.sum("n").over(Window.partitionBy(FILE).orderBy(SPLIT).rowsBetween(Window.unboundedPreceding, -1))  # a row a split
    own = each.withColumn("before", F.coalesce(before, F.lit(0))).select(FILE, "first", "before", F.explode("hits").alias("h"))
    return own.select(F.col(FILE).alias("file"), (F.col("before") + F.col(f"h.{ROW}") - F.col("first") + 1).alias("line_no"), "h.line")


def latest_records(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """The last record of each key in JSON lines without a sequence column: later files by name, then later lines win. Lines that are no
    record of the schema are left out."""
    parsed = F.from_json("line", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = _lines(spark, path).withColumn("r", parsed).where("r is not null and r._corrupt is null")
    names = [c for c in rows.select("r.*").columns if c != "_corrupt"]
    last = rows.groupBy(*(F.col(f"r.{k}").alias(k) for k in keys)).agg(F.max_by("r", F.struct(FILE, SPLIT, ROW)).alias("r"))
    return last.select(*(f"r.{c}" for c in names))


def read_manifest_csv(spark: SparkSession, path: str, types: dict[str, str]) -> DataFrame:
    """A CSV with a header, with or without a byte order mark; the columns named in types are cast, what does not fit becomes null."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    named = raw.toDF(*(c.replace(BOM, "").strip() for c in raw.columns))
    return named.select(*(F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in named.columns))


def write_table(df: DataFrame, path: str, columns: dict[str, str], kind: str = "parquet", by: list[str] | None = None) -> None:
    """Writes the columns (name: type) in this order; those that df lacks are null, others are left out."""
    out = df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()))
    writer = out.write.option("header", True).format(kind)
    (writer.partitionBy(*by) if by else writer).save(path)


def delivered_manifest(records: DataFrame, delivered: Column, key: str, columns: dict[str, Column]) -> DataFrame:
    """frame_id and the given columns of delivered records."""
    return records.where(delivered).select(F.format_string("f%08d", F.col(key).cast("bigint")).alias("frame_id"), *(c.alias(k) for k, c in columns.items()))
