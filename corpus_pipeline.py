"""A training corpus from documents: quality rules, near-dedup, substring dedup, decontamination, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.llm import decontam, packing, probminhash, quality_rules, superkmer
from lodestat.llm.common import materialize, read

#: SQL has no counterpart of the hashed quality rules, the signatures and the packing. The tests compare run() with brute force on small tables, and its stages on odd ones.
ORACLE_SQL = None


def _apart(docs: DataFrame, stage: Callable[[DataFrame], DataFrame], read_too: tuple[str, ...] = ()) -> DataFrame:
    """stage(docs), with the columns of docs alone and as they were but for the text: while it runs, columns that it does not read have names
    that no operator gives."""
    hidden = {c: f"_kept_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", *read_too)}
    out = stage(docs.withColumnsRenamed(hidden))
    return out.select(*(F.col(hidden.get(c, c)).alias(c) for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts have no word and go; rows that repeat, or have no doc_id, are judged each by
    their own text. No rows give no rows."""
    labels = read(spark, sf_dir, "labels")
    judge = lambda d: quality_rules.quality_rules(d, quality_rules.trusted_rows(labels), rejected=quality_rules.rejected_rows(labels)).where("kept")
    return _apart(docs, judge)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that with the least doc_id (null last), then the least text. Of texts without a word one
    row stays for each doc_id. No rows give no rows."""
    return _apart(docs, probminhash.deduplicate)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the words of repeated windows; those that have no word left, nulls and empty texts among them, go. n_chars, if there is
    such a column, follows the text where words were removed."""

    def cut(d: DataFrame) -> DataFrame:
        out = superkmer.remove_repeats(d).where("n_words > n_removed")
        if "n_chars" not in docs.columns:
            return out
        size = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        return out.withColumn("n_chars", size)

    return _apart(docs, cut, ("n_chars",))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark; null and empty texts are not. No rows give no rows."""
    clean = lambda d: decontam.decontaminate(d, read(spark, sf_dir, "benchmark")).where("not contaminated")
    return _apart(docs, clean)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences; a null or empty text is its end mark alone. No rows give no rows."""
    return packing.pack(docs)


STAGES = [("quality rules", quality), ("near-dedup", near_dedup), ("substring dedup", substring_dedup), ("decontamination", decontaminate), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written as Parquet in the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
