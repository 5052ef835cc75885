"""Shared pieces: word columns, materialised tables, checked broadcasts and Arrow slicing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: the six ASCII white-space characters.
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows that a broadcast side may have; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
_GOLDEN, _M1, _M2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and Spark is local (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lodestat-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/lodestat-{uuid.uuid4().hex}-{name}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: it is computed once and survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows, else df as it is, for a shuffled join. df should be materialised."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, even if lambdas in body use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; null gives none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII texts take the fast function."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def word_hashes(array: Column) -> Column:
    return F.transform(array, lambda w: F.xxhash64(w))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, for uint64 arrays."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def rolling(h: np.ndarray, width: int, factor: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of h[i:i+width] for each i, a polynomial modulo 2**64 from running sums; the last width - 1 entries are of shorter runs."""
    n, p = len(h), factor | 1
    powers = lambda x: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)]))[:n]
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers(p))])
        return mix((total[np.minimum(np.arange(n) + width, n)] - total[:n]) * powers(pow(p, -1, 1 << 64)))


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores added as it takes to differ from all columns; Spark compares names without case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def sliced(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the lists or strings of a column sum up to about `most` at a time; a longer row comes alone."""
    for batch in batches:
        col = batch.column(column)
        size = pc.list_value_length(col) if pa.types.is_list(col.type) or pa.types.is_large_list(col.type) else pc.binary_length(col)
        total = np.cumsum(pc.fill_null(size, 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at, base = 0, 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(total, base + most, "right")))
            yield batch.slice(at, end - at)
            at, base = end, int(total[end - 1])


def ragged(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list<bigint> column as uint64, and the offsets of its rows."""
    n = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)
    return values, np.concatenate([[0], np.cumsum(n)])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(key: Column, modulus: int, remainder: int = 2) -> Column:
    """True for rows whose crc32 of the key as text leaves the remainder; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def crc_sql(text: str) -> str:
    """DuckDB SQL for the CRC-32 of an ASCII text, bit by bit."""
    bits = "list_reduce([xor(c, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    return f"xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length({text}) + 1), lambda j: ascii(substr({text}, j, 1))::BIGINT), lambda c, b: {bits}), 4294967295::BIGINT)"
