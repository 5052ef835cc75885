"""What keeps queries in proportion to their input: expressions that are not interpreted row by row, packed groups, single passes."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestat import catalog
from lodestat.functions import polygons


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# hulls


def test_hulls_are_computed_by_the_batch(spark, data):
    for name in ("q13_02_hull_iou", "q13_02_clipped_hull", "q13_02_hull"):
        assert "lambda" not in plan(catalog.queries()[name](spark, data))


def test_point_sets_of_all_sizes_in_a_batch(spark):
    rng = random.Random(3)
    square = lambda n: [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]] + [[rng.random(), rng.random()] for _ in range(n)]
    sets = [square(n) for n in (0, 3000, 5, 40, 0)] + [[], [[2.0, 2.0]], [[0.0, 0.0], [3.0, 3.0]], [[0.5, 0.5]] * 9, None, [[0.0, None], [1.0, 1.0], [0.0, 1.0]]]
    df = spark.createDataFrame(list(enumerate(sets)), "i long, p array<array<double>>").coalesce(1)
    got = {r.i: r.h for r in df.select("i", polygons.hull_in_image(F.col("p"), 0.5, 9.0).alias("h")).collect()}
    assert [round(got[i].area, 9) for i in range(9)] == [1.0] * 5 + [0.0] * 4
    assert [round(got[i].clipped, 9) for i in range(9)] == [0.5] * 5 + [0.0] * 4
    assert [got[i].iou for i in range(5)] == [1.0] * 5 and got[9] is None and got[10] is None


# boxes


def test_box_checks_are_compiled(spark, data):
    for name in ("q11_07_verify_cuboid", "q11_10_self_visible"):
        assert "lambda" not in plan(catalog.queries()[name](spark, data))


def test_camera_in_the_plane_of_a_face(spark):
    from lodestat.functions import cuboids

    rows = []
    for i in range(60):
        c, s = math.cos(0.1 * i), math.sin(0.1 * i)
        turn = lambda x, y, z: [c * x - s * y + 5.0, s * x + c * y - 3.0, z + 2.0]
        corners = [turn(x * 21.0, y * 40.5, z * 2.0) for x in (-0.5, 0.5) for y in (-0.5, 0.5) for z in (-1, 1)]
        rows.append((i, corners, turn(10.5, 0.0, 4.0)))
    got = spark.createDataFrame(rows, "i long, p array<array<double>>, eye array<double>").select(cuboids.visible_corners(F.col("p"), F.col("eye")).alias("v"))
    assert all(r.v == [False, True] * 4 for r in got.collect())  # the top alone: the side at x = 10.5 is seen edge-on
    odd = [([[0.0, 0.0, 0.0]] * 7, [1.0, 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (rows[0][1], None), (rows[0][1], [1.0, None, 2.0])]
    assert all(r.v is None for r in spark.createDataFrame(odd, "p array<array<double>>, eye array<double>").select(cuboids.visible_corners(F.col("p"), F.col("eye")).alias("v")).collect())


# sums of doubles


def test_means_do_not_depend_on_how_rows_are_split(spark, data, tmp_path):
    import duckdb

    con = duckdb.connect()
    con.execute("SET threads = 1")
    (tmp_path / "lineitem.parquet").mkdir()
    for i in range(12):
        con.execute(f"COPY (SELECT * FROM '{data}/lineitem.parquet' LIMIT 500 OFFSET {500 * i}) TO '{tmp_path}/lineitem.parquet/part-{i:02}.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.execute(catalog.oracle_sql()["q3_04_paired_compare"])
    names, want = [c[0] for c in want.description], want.fetchone()
    for folder in (data, str(tmp_path)):
        got = catalog.queries()["q3_04_paired_compare"](spark, folder).select(*names).first()
        assert tuple(got) == pytest.approx(want, abs=1e-6)


# streams


def test_two_runs_take_every_event_once(spark, data, tmp_path, monkeypatch):
    from lodestat.plans import streams

    median, other = F.percentile_approx, F.udf(lambda m: m + random.SystemRandom().randint(-m // 2, m // 2), "long")
    monkeypatch.setattr(F, "percentile_approx", lambda *a: other(median(*a)))  # as merging sketches in another order may give another number
    events = streams._in_two_runs(spark, data, str(tmp_path), lambda s: spark.read.parquet(f"{tmp_path}/in"))
    got = sorted(r.event_id for r in events.select("event_id").collect())
    assert got == sorted(r.event_id for r in spark.read.parquet(f"{data}/events.parquet").select("event_id").collect())


# densities


def test_density_of_every_row_at_its_own_place(spark):
    from lodestat.operators import density

    x, y = np.array([0.5, 3.01, 3.02, 9.9] * 30), np.array([1.0, 2.03, 7.77, 9.99] * 30)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double").repartition(3)
    g, h = np.linspace(0, 10, 9), lambda v: v.std() * len(v) ** (-1 / 6)
    for circular in (False, True):
        got = {(r.gx, r.gy): r.density for r in density.kde2d(df, "x", "y", (0, 10, 0, 10), 9, circular=circular).collect()}
        k = lambda v, images: sum(np.exp(-0.5 * ((g[:, None] - z) / h(v)) ** 2) for z in images)
        d = k(x, (x, x - 10, x + 10) if circular else (x, -x, 20 - x)) @ k(y, (y, -y, 20 - y)).T
        d /= d.sum()
        assert max(abs(got[a, b] - d[i, j]) for i, a in enumerate(g) for j, b in enumerate(g)) < 1e-12
    assert density.kde2d(df.limit(0), "x", "y", (0, 10, 0, 10), 9).count() == 0


# skylines


def test_skylines_of_many_small_groups_share_calls(spark, monkeypatch):
    from lodestat.operators import skyline

    rows = [(None if g == 7 else f"g{g % 40}", i, bool(i % 3), float(-(i * 7 % 11)), float(-(i * 5 % 13))) for g in range(40) for i in range(30)] + [("large", i, True, float(-i), float(i - 2000)) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, i long, f boolean, a double, b double")
    kept = lambda block: sorted((str(r.g), r.i) for r in skyline.skyline(df, ["g"], ["f"], ["a", "b"], F.lit(True), block).collect())
    whole = lambda r, q: all(x >= y for x, y in zip(q[2:], r[2:])) and q[2:] != r[2:]
    small = [(str(r[0]), r[1]) for r in rows if r[0] != "large" and not any(q[0] == r[0] and whole(r, q) for q in rows)]
    assert kept(100) == kept(20_000) == sorted(small + [("large", i) for i in range(2000)])
    calls = spark.sparkContext.accumulator(0)
    real = type(df.groupBy("g")).applyInArrow
    monkeypatch.setattr(type(df.groupBy("g")), "applyInArrow", lambda self, f, kind: real(self, lambda t: (calls.add(1), f(t))[1], kind))
    assert len(kept(20_000)) > 2000 and calls.value < 10  # one call a group and bucket before: more than 40


# nested


def test_equal_parts_of_json_are_not_gone_through(spark, monkeypatch):
    from lodestat.operators import nested

    left = [(1, '{"a": {"x": [1, 2]}, "b": 1, "run": 1}'), (2, '{"a": null, "b": 1, "run": 1}'), (3, '{"b": 1, "a": {}, "run": 1}'), (4, "no json"), (5, None)]
    right = [(1, '{"a": {"x": [1, 2]}, "b": 1, "run": 2}'), (2, '{"a": 7, "b": 1, "run": 2}'), (3, '{"a": {}, "b": 2, "run": 2}'), (4, "[1]"), (5, "1")]
    written, real = [], nested.materialize
    monkeypatch.setattr(nested, "materialize", lambda df, name: written.append(real(df, name)) or written[-1])
    a, b = (spark.createDataFrame(rows, "i long, j string") for rows in (left, right))
    got = {r.i: tuple(r)[1:] for r in nested.json_diff(a, b, "i", "j", ["run"]).collect()}
    assert got == {2: ("$.a", "type", "VOID", "BIGINT"), 3: ("$.b", "value", "1", "2"), 4: ("$", "type", "INVALID", "ARRAY"), 5: ("$", "type", "INVALID", "BIGINT")}
    assert [df.count() for df in written] == [5, 2]  # all nodes of both sides before: 24


# files, resampling


def test_splits_do_not_grow_with_the_files(spark, tmp_path):
    from lodestat.plans.files import _split_small

    for name, lines in (("small", 3_000), ("large", 900_000)):
        spark.range(lines).select(F.format_string("%015d", "id")).coalesce(1).write.text(f"{tmp_path}/{name}")
        read = _split_small(spark, f"{tmp_path}/{name}").read.text(f"{tmp_path}/{name}")
        assert read.count() == lines and 2 < read.rdd.getNumPartitions() < 300  # 880 splits of the large one before


def test_bootstrap_weights_are_found_by_the_batch(spark):
    import hashlib

    from lodestat.operators import density

    df = spark.range(300).select("id", F.col("id").cast("double").alias("v"))
    means = density.bootstrap_means(df, "id", "v", 6, 7)
    assert "conv(" not in plan(means)
    for r in means.collect():
        u = [int(hashlib.md5(f"{i}|{r.replicate // 4}|7".encode()).hexdigest()[8 * (r.replicate % 4) : 8 * (r.replicate % 4) + 8], 16) / 2**32 for i in range(300)]
        w = [sum(x >= p for p in density.POISSON) for x in u]
        assert math.isclose(r.mean, sum(i * x for i, x in enumerate(w)) / sum(w))


# chains


def test_successor_rows_travel_without_what_is_judged(spark):
    from lodestat.operators import chains

    sha = lambda k: f"{k:064x}"
    m = [(k, "d", f"{k}.bin", "m", k, f"d/{k}.bin", f"e/{k}.bin", 1, s) for k, s in enumerate([sha(0), sha(1), sha(255).upper(), "odd", sha(4), None])]
    later = [("m", k, f"d/{k}.bin", f"e/{k}.bin", "MOVED", "t", s) for k, s in enumerate([sha(0), sha(9), sha(255), "odd", sha(4), sha(5)])]
    prior = [(k, "d", f"{k}.bin", 1, s) for k, s in enumerate([sha(0), sha(1), sha(255).upper(), "Odd", None, sha(5)])]
    there = [(f"e/{k}.bin", 1, s) for k, s in enumerate([sha(0), sha(1), sha(255).upper(), "odd", sha(4), sha(5)])]
    kinds = ("prior_move long, prior_destination string, prior_path string, successor_manifest string, successor_move long, successor_source string, successor_destination string, size int, sha string", "move long, destination string, path string, size int, sha string", "manifest string, move long, source string, destination string, status string, verified_at string, sha string", "path string, size int, sha string")
    out = chains.successor_issues(*(spark.createDataFrame(r, k) for r, k in zip((m, prior, later, there), kinds)))
    assert {r.prior_move: r.issues for r in out.collect()} == {0: [], 1: ["SUCCESSOR_PRE_HASH"], 2: ["SUCCESSOR_PRE_HASH"], 3: ["PRIOR_SHA256"], 4: ["PRIOR_HASH_MISSING"], 5: ["FIELD_MISSING", "PRIOR_SHA256", "SUCCESSOR_PRE_HASH", "DESTINATION_SHA256"]}
    last = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    top = next(line for line in last if "Join LeftOuter" in line and "own" in line)
    below = last[last.index(top) + 1]
    assert "sha" not in below and "bits" in below  # the last join's rows had all columns before


# packages


def test_shared_folder_of_packages(spark):
    from lodestat.operators import evaluation

    cases = [  # paths of the package, paths of the tree, level
        (["a/b/1", "a/b-x/2", "a/b/c/3"], ["b/1", "b-x/2", "b/c/3"], 4),  # "a/b" and "a/b/c" enclose "a/b-x" in order of text
        (["/a/1", "/b/2"], ["a/1", "b/2"], 4),
        (["p/q/1", "p/q/2"], ["1", "2"], 4),
        (["p/q/1", "p/r/1"], ["q/1", "r/1"], 4),
        (["p/q/1", "p/r/1"], ["q/1", "s/1"], 2),
        (["a/1", "a//2"], ["1", "/2"], 4),
        (["1", "/2"], ["x/1", "x//2"], 4),
        (["1", "a/2"], ["t/1", "t/a/2"], 4),
        (["a/é/1", "a/é/ü/2"], ["1", "ü/2"], 4),
        (["ab/1", "ac/1"], ["b/1", "c/1"], 2),
        (["one"], ["x/y/one"], 4),
    ]
    table = lambda k: spark.createDataFrame([(i, p, j, j) for i, c in enumerate(cases) for j, p in enumerate(c[k])], "i long, path string, size long, crc long")
    got = {r.i: r.level for r in evaluation.match_levels(table(0), table(1), "i").collect()}
    assert got == {i: c[2] for i, c in enumerate(cases)}


def test_packages_are_cut_without_nested_lambdas(spark, data):
    text = plan(catalog.queries()["q8_05_match_levels"](spark, data))
    assert "forall" not in text and "regexp_replace" not in text


# agreement


def test_agreement_computes_its_pairs_once(spark, data):
    text = plan(catalog.queries()["q9_01_agreement"](spark, data))
    assert "FileScan" in text and "l_partkey" not in text and "p_partkey" not in text


def test_rank_correlation_joins_rows_once(spark):
    from lodestat.operators import tables

    rng = random.Random(8)
    rows = [(g, rng.random(), rng.choice([rng.random(), 0.5])) for g in ("a", None) for _ in range(300)] + [("flat", float(i), 2.0) for i in range(4)] + [("none", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    out = tables.spearman(df, "x", "y", "g")
    assert "Scan ExistingRDD" not in plan(out)  # ranks are read, rows no more
    got = {r.g: r.spearman for r in out.collect()}
    rank = lambda v: np.array([sum(b < a for b in v) + (sum(b == a for b in v) + 1) / 2 for a in v])
    for g in ("a", None):
        x, y = zip(*((x, y) for k, x, y in rows if k == g), strict=True)
        assert math.isclose(got[g], np.corrcoef(rank(x), rank(y))[0, 1], abs_tol=1e-9)
    assert got["flat"] is None and set(got) == {"a", None, "flat"}
