"""Streams with state of their own: repeats that are flagged, and runs that end at a number of usable rows or at a cap.

State is in RocksDB (spark.sql.streaming.stateStore.providerClass is set for the job) and in the checkpoint below the job's folder, so that a
job that is started again goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from lodestat.streaming.jobs import stored

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Repeats(StatefulProcessor):
    """State: whether the key has been seen; forgotten after ttl_ms if that is given."""

    def __init__(self, order: list[str], ttl_ms: int | None) -> None:
        self.order, self.ttl_ms = order, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n bigint", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = self.seen.get() if self.seen.exists() else None
        all_rows = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        before = int(found[0]) if found else 0
        out = all_rows.assign(is_repeat=[before + i > 0 for i in range(len(all_rows))])
        self.seen.update((before + len(all_rows),))
        yield out

    def close(self) -> None:
        pass


class _Completion(StatefulProcessor):
    """State of a run: attempts, delivered and status. Rows are attempts in the order of a column; those after the end are not counted.
    A run of which no row has come for idle_ms is reported as stalled."""

    def __init__(self, order: str, n: int, cap: int, idle_ms: int | None) -> None:
        self.order, self.n, self.cap, self.idle_ms = order, n, cap, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", "attempts bigint, delivered bigint, status string")

    def _said(self, key, state: tuple) -> pd.DataFrame:
        return pd.DataFrame({"run": [key[0]], "attempts": [state[0]], "delivered": [state[1]], "status": [state[2]]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        attempts, delivered, status = self.state.get() if self.state.exists() else (0, 0, "incomplete")
        all_rows = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        for usable in all_rows["usable"]:
            if status in ("complete", "cap_hit"):
                break
            attempts, delivered = attempts + 1, delivered + bool(usable)
            status = "complete" if delivered == self.n else "cap_hit" if attempts == self.cap else "incomplete"
        state = (int(attempts), int(delivered), status)
        self.state.update(state)
        for timer in list(self.handle.listTimers()) if self.idle_ms else []:
            self.handle.deleteTimer(timer)
        if self.idle_ms and status == "incomplete":
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self._said(key, state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        attempts, delivered, status = self.state.get()
        if status == "incomplete":
            self.state.update((attempts, delivered, "stalled"))
            yield self._said(key, (attempts, delivered, "stalled"))

    def close(self) -> None:
        pass


def _with_rocks(stream: DataFrame, start):
    """Starts a query with the RocksDB provider, which a query keeps from its start, and leaves the session's setting as it was."""
    conf = stream.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKS)
    try:
        return start()
    finally:
        conf.set(PROVIDER, before) if before else conf.unset(PROVIDER)


def _trigger(writer, clock: int | None):
    """availableNow does not end for a query whose state depends on the clock, for there is always another batch."""
    return writer.trigger(processingTime="0 seconds") if clock else writer.trigger(availableNow=True)


def _run_out(query, clock: bool, ended=lambda: False, wait: bool = False) -> None:
    """Waits until a query has ended; stops it when ended() says so, or, if it goes by the clock, at a batch without rows. That must not be
    the first one, which may be an old batch that is repeated."""
    while not query.awaitTermination(0.2):
        past = query.recentProgress
        if ended() or (clock and not wait and len(past) > 1 and past[-1]["numInputRows"] == 0):
            query.stop()


def flag_repeats(stream: DataFrame, keys: list[str], order: list[str], folder: str, ttl_ms: int | None = None) -> DataFrame:
    """All records with is_repeat: whether a record of the same keys came before, in an earlier batch or in the order given in its own.
    With ttl_ms a key is forgotten that long after its last record, and keys are not null.

    Without ttl_ms Spark's own deduplication says which keys a batch brings, and no key is handed to Python. Both sides of the union have one
    source, so they see the same records in each batch."""
    kinds = StructType([*stream.schema.fields]).add("is_repeat", "boolean")
    if ttl_ms:
        out = stream.groupBy(*keys).transformWithStateInPandas(_Repeats(order, ttl_ms), kinds, "Append", "ProcessingTime")
        flagged = lambda df: df
    else:
        brought = stream.select(*keys).dropDuplicates().withColumn("_brought", F.lit(True))
        out = stream.withColumn("_brought", F.lit(False)).unionByName(brought, allowMissingColumns=True)
        w = Window.partitionBy(*keys).orderBy(F.desc("_brought"), *(F.asc_nulls_last(c) for c in order))
        first = F.lag("_brought", 1, False).over(w)  # the record behind the row that says that its key is new
        flagged = lambda df: df.withColumn("is_repeat", ~first).where(~F.col("_brought")).select(*kinds.names)
    write = lambda df, batch: flagged(df).write.mode("overwrite").parquet(f"{folder}/flagged/batch={batch}")
    writer = out.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(write)
    _run_out(_with_rocks(stream, _trigger(writer, ttl_ms).start), bool(ttl_ms))
    found = stored(stream.sparkSession, f"{folder}/flagged")
    return stream.sparkSession.createDataFrame([], kinds) if found is None else found.select(*kinds.names)


def complete_runs(stream: DataFrame, run: str, order: str, usable: str, n: int, cap: int, folder: str, runs: int | None = None, idle_ms: int | None = None, wait: bool = False) -> DataFrame:
    """(run, attempts, delivered, status): each run ends as complete at its n-th usable row or as cap_hit at `cap` attempts, else it is
    incomplete. The query stops as soon as `runs` runs have ended, if that is given, and else when all input is read; with wait it goes on
    waiting for input, and a run without rows for idle_ms is stalled."""
    spark = stream.sparkSession
    rows = stream.select(F.col(run).alias("run"), F.col(order).alias(order), F.coalesce(usable, F.lit(False)).alias("usable"))
    kinds = StructType([rows.schema["run"]]).add("attempts", "long").add("delivered", "long").add("status", "string")
    out = rows.groupBy("run").transformWithStateInPandas(_Completion(order, n, cap, idle_ms), kinds, "Update", "ProcessingTime" if idle_ms else "None")
    done: list[int] = []

    def each(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/status/batch={batch}")
        if runs is not None:
            ended = completion(spark, kinds, folder).where("status <> 'incomplete'").count()
            if ended >= runs:
                done.append(batch)

    clock = idle_ms or int(wait)
    writer = out.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(each)
    _run_out(_with_rocks(stream, _trigger(writer, clock).start), bool(clock), lambda: bool(done), wait)
    return completion(spark, kinds, folder)


def completion(spark, kinds: StructType, folder: str) -> DataFrame:
    """The newest status of each run below a folder of complete_runs."""
    found = stored(spark, f"{folder}/status")
    if found is None:
        return spark.createDataFrame([], kinds)
    return found.groupBy("run").agg(F.max_by(F.struct("attempts", "delivered", "status"), "batch").alias("x")).select("run", "x.*")
