"""Streaming jobs that stop and go on: what was read is not read again, what is new joins what was there."""

import datetime as dt

from lodestat.streaming import jobs

SCHEMA = "k string, n long, ts timestamp"


def put(spark, path, rows):
    spark.createDataFrame([(k, n, dt.datetime(2024, 1, 1, 0, minute)) for k, n, minute in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_jobs_resume(spark, tmp_path):
    source, out = str(tmp_path / "in"), "file://" + str(tmp_path / "out")
    stream = lambda: jobs.records(spark, source, SCHEMA)

    def run():
        yes, no = jobs.split_records(stream(), jobs.F.col("n") > 1, f"{out}/split")
        return (
            sorted(r.n for r in yes.collect()),
            sorted((r.n is None, r.n or 0) for r in no.collect()),
            {r.k: r.n for r in jobs.counters(stream(), ["k"], f"{out}/counts").collect()},
            sorted(r.k for r in jobs.first_seen(stream().select("k"), ["k"], f"{out}/first").collect() if r.k),
            {r.k: r.n for r in jobs.latest(stream().where("k is not null"), ["k"], ["ts"], f"{out}/latest").collect()},
        )

    put(spark, source, [("a", 1, 0), ("a", 2, 1), ("b", None, 2), (None, 5, 3)])
    first = ([2, 5], [(False, 1), (True, 0)], {"a": 2, "b": 1, None: 1}, ["a", "b"], {"a": 2, "b": None})
    assert run() == first
    assert run() == first
    put(spark, source, [("a", 7, 5), ("c", 0, 0), ("b", 3, 1)])
    assert run() == ([2, 3, 5, 7], [(False, 0), (False, 1), (True, 0)], {"a": 3, "b": 2, "c": 1, None: 1}, ["a", "b", "c"], {"a": 7, "b": None, "c": 0})


def test_late_records_are_dropped(spark, tmp_path):
    source, out = str(tmp_path / "in"), "file://" + str(tmp_path / "out")

    def run():
        found = jobs.throughput(jobs.records(spark, source, SCHEMA), "ts", out, "10 minutes", "5 minutes").collect()
        return sorted((r.start.minute, r.n) for r in found)

    put(spark, source, [("a", 1, 1), ("a", 1, 2), ("a", 1, 30)])
    assert run() == [(0, 2)]
    put(spark, source, [("a", 1, 3), ("a", 1, 31), ("a", 1, 50)])
    assert run() == [(0, 2), (30, 2)]
