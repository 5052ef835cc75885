"""Streams with kept state and the bucketed snapshot: restarts, stops, untouched files, lost manifests."""

import glob
import shutil

import pytest

from lodestat.streaming import jobs, stateful


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return jobs.records(spark, f"{folder}/in")


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    folder, schema = str(tmp_path), "k long, t long, v string"
    out = jobs.latest(put(spark, folder, [(i, 0, "old") for i in range(400)], schema), ["k"], ["t"], f"{folder}/job", buckets=16)
    assert out.count() == 400
    first = set(glob.glob(f"{folder}/job/data/version=0/bucket=*"))
    assert len(first) == 16
    out = jobs.latest(put(spark, folder, [(7, 1, "new"), (8, -1, "late")], schema), ["k"], ["t"], f"{folder}/job", buckets=16)
    rows = {r.k: r.v for r in out.collect()}
    assert len(rows) == 400 and rows[7] == "new" and rows[8] == "old"
    assert len(glob.glob(f"{folder}/job/data/version=1/bucket=*")) <= 2
    kept = {r.bucket: r.version for r in spark.read.parquet(f"{folder}/job/manifest/batch=1").collect()}
    assert sorted(kept) == list(range(16)) and sum(v == 0 for v in kept.values()) >= 14


def test_a_lost_manifest_is_an_error(spark, tmp_path):
    folder, schema = str(tmp_path), "k long, t long"
    jobs.latest(put(spark, folder, [(1, 0)], schema), ["k"], ["t"], f"{folder}/job")
    shutil.move(f"{folder}/job/manifest/batch=0", f"{folder}/elsewhere")
    with pytest.raises(Exception):
        jobs.latest(put(spark, folder, [(2, 0)], schema), ["k"], ["t"], f"{folder}/job")


def test_stored_raises_what_is_no_missing_path(spark, tmp_path):
    assert jobs.stored(spark, f"{tmp_path}/none") is None
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        jobs.stored(spark, f"{tmp_path}/bad")


def test_repeats_are_flagged_over_a_restart(spark, tmp_path):
    folder, schema = str(tmp_path), "k string, i long"
    job = lambda s: stateful.flag_repeats(s, ["k"], ["i"], f"{folder}/job")
    assert {r.i: r.is_repeat for r in job(put(spark, folder, [("a", 1), ("b", 2), ("a", 3)], schema)).collect()} == {1: False, 2: False, 3: True}
    got = {r.i: r.is_repeat for r in job(put(spark, folder, [("a", 4), ("c", 5), ("c", 6)], schema)).collect()}
    assert got == {1: False, 2: False, 3: True, 4: True, 5: False, 6: True}


def test_repeats_are_flagged_without_python_for_each_key(spark, tmp_path, monkeypatch):
    from pyspark.sql import GroupedData

    def refuse(*a, **k):
        raise AssertionError("keys are handed to Python one at a time")

    monkeypatch.setattr(GroupedData, "transformWithStateInPandas", refuse)
    folder, schema = str(tmp_path), "k string, t int, i long, v double"
    job = lambda: stateful.flag_repeats(jobs.records(spark, f"{folder}/in", files_per_batch=1), ["k", "t"], ["i"], f"{folder}/job")
    odd = 2**53 + 1
    files = [
        [("a", 1, odd, 0.5), ("a", 1, odd + 2, None), ("a", 2, 7, 0.1), (None, 1, 9, 0.2), ("b", None, 3, 0.3)],
        [("a", 1, 1, 0.5), (None, 1, 4, 0.2), ("c", 1, None, 1.0), ("c", 1, 5, 2.0), ("d", 1, 6, 3.0), ("d", 1, 6, 4.0)],
        [("b", None, 1, 0.0), ("c", 1, 0, 0.0), ("e", 1, 8, 0.0), *(("f", i, i, 0.0) for i in range(100))],
    ]
    for part in (files[:2], files[2:]):  # the second run goes on where the first has stopped
        for rows in part:
            put(spark, folder, rows, schema)
        got = sorted(((r.k, r.t, r.i, r.v), r.is_repeat) for r in job().collect() if r.k != "d" and None not in (r.k, r.t, r.i, r.v))
    want = [("a", 1, 1, True), ("a", 1, odd, False), ("a", 2, 7, False), ("c", 1, 0, True), ("c", 1, 5, False), ("e", 1, 8, False), *(("f", i, i, False) for i in range(100))]
    assert [(*r[:3], f) for r, f in got] == want
    rows = job().collect()
    assert len(rows) == sum(map(len, files)) and sorted(r.is_repeat for r in rows if r.k == "d") == [False, True]
    flags = {(r.k, r.t, r.i): r.is_repeat for r in rows if None in (r.k, r.t, r.i, r.v)}
    assert flags == {("a", 1, odd + 2): True, (None, 1, 9): False, (None, 1, 4): True, ("b", None, 3): False, ("b", None, 1): True, ("c", 1, None): True}
    assert len(glob.glob(f"{folder}/job/checkpoint/sources/*")) == 1  # both sides of the union read one source
    assert len(glob.glob(f"{folder}/job/flagged/batch=*")) == 3


def test_a_key_is_forgotten_after_its_time(spark, tmp_path):
    import time

    folder, schema = str(tmp_path), "k string, i long"
    job = lambda s: stateful.flag_repeats(s, ["k"], ["i"], f"{folder}/job", ttl_ms=1000)
    job(put(spark, folder, [("a", 1)], schema))
    time.sleep(2)
    assert {r.i: r.is_repeat for r in job(put(spark, folder, [("a", 2), ("a", 3)], schema)).collect()} == {1: False, 2: False, 3: True}


SCHEMA = "run string, i long, ok boolean"


def test_runs_end_at_n_or_at_the_cap_over_a_restart(spark, tmp_path):
    folder = str(tmp_path)
    job = lambda s: stateful.complete_runs(s, "run", "i", "ok", 2, 4, f"{folder}/job")
    rows = [("a", 1, True), ("a", 2, False), ("b", 1, None), ("b", 2, False), ("b", 3, False), ("c", 1, False)]
    got = {r.run: tuple(r)[1:] for r in job(put(spark, folder, rows, SCHEMA)).collect()}
    assert got == {"a": (2, 1, "incomplete"), "b": (3, 0, "incomplete"), "c": (1, 0, "incomplete")}
    rows = [("a", 4, True), ("a", 3, True), ("b", 4, False), ("b", 5, True)]
    got = {r.run: tuple(r)[1:] for r in job(put(spark, folder, rows, SCHEMA)).collect()}
    assert got == {"a": (3, 2, "complete"), "b": (4, 0, "cap_hit"), "c": (1, 0, "incomplete")}


def test_a_waiting_query_stops_when_all_runs_have_ended(spark, tmp_path):
    folder = str(tmp_path)
    s = put(spark, folder, [("a", 1, True), ("b", 1, False), ("b", 2, False)], SCHEMA)
    got = stateful.complete_runs(s, "run", "i", "ok", 1, 2, f"{folder}/job", runs=2, wait=True)
    assert {r.run: r.status for r in got.collect()} == {"a": "complete", "b": "cap_hit"}


def test_an_idle_run_is_stalled(spark, tmp_path):
    folder = str(tmp_path)
    s = put(spark, folder, [("a", 1, False)], SCHEMA)
    got = stateful.complete_runs(s, "run", "i", "ok", 1, 5, f"{folder}/job", runs=1, idle_ms=1000, wait=True)
    assert {r.run: (r.attempts, r.status) for r in got.collect()} == {"a": (1, "stalled")}


def test_folders_must_be_shared_outside_local_mode(spark, monkeypatch):
    from lodestat import storage

    class Session:
        class conf:
            @staticmethod
            def get(key, default):
                return None

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        storage.shared_dir(Session)
