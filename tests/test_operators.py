"""Order over range partitions, skylines, nested comparison, chains, split logs, hulls and boxes against plain Python."""

import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestat.functions import cuboids, polygons
from lodestat.operators import chains, choices, density, nested, skyline, tables
from lodestat.operators.ranges import numbered, running
from lodestat.sources import files


@pytest.fixture
def many_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


# ranges


def test_running_values_equal_windows(many_parts):
    df = many_parts.range(4000).select((F.when(F.col("id") % 3 > 0, F.lit(1)).when(F.col("id") % 2 == 0, F.col("id") % 50)).alias("g"), F.hash("id").cast("long").alias("v"), "id")
    high = F.when(F.col("id") % 100 == 3, F.col("id"))
    got = running(df, ["g"], ["v", "id"], n=("count", F.lit(1)), s=("sum", F.col("v")), x=("xor", F.col("id")), m=("max", high), l=("min", F.col("v")))
    w = Window.partitionBy("g").orderBy("v", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumns({"n": F.count(F.lit(1)).over(w), "s": F.sum("v").over(w), "x": F.bit_xor("id").over(w), "m": F.max(high).over(w), "l": F.min("v").over(w)})
    assert got.count() == 4000 and got.exceptAll(want).isEmpty()
    assert [r.number for r in numbered(df, [], ["id"]).orderBy("id").collect()] == list(range(1, 4001))
    assert running(df.limit(0), ["g"], ["id"], n=("count", F.lit(1))).count() == 0


def test_spearman_and_ranks_with_ties_and_nulls(spark):
    rng = random.Random(3)
    rows = [(g, rng.choice([None, 1.0, 2.0, 3.5, rng.random()]), rng.choice([None, 0.0, rng.random()])) for g in ("a", "b", None) for _ in range(40)] + [("flat", 1.0, float(i)) for i in range(5)]
    got = {r.g: r.spearman for r in tables.spearman(spark.createDataFrame(rows, "g string, x double, y double"), "x", "y", "g").collect()}
    rank = lambda v: [sum(b < a for b in v) + (sum(b == a for b in v) + 1) / 2 for a in v]
    for g in ("a", "b", None):
        pairs = [(x, y) for k, x, y in rows if k == g and x is not None and y is not None]
        assert math.isclose(got[g], np.corrcoef(rank([x for x, _ in pairs]), rank([y for _, y in pairs]))[0, 1], abs_tol=1e-9)
    assert got["flat"] is None


# skylines


@pytest.mark.parametrize("block", [3, 1000])
def test_skyline_equals_pairs(spark, block):
    rng = random.Random(block)
    rows = [(i, rng.choice(["x", None]), rng.choice([True, False, None]), *(rng.choice([None, -2.0, -1.0, -0.0, 0.0, 0.5, round(rng.uniform(-3, 1), 1)]) for _ in range(3)), rng.random() < 0.9) for i in range(150)]
    df = spark.createDataFrame(rows, "i long, g string, f boolean, a double, b double, c double, hard boolean")
    got = {r.i for r in skyline.skyline(df, ["g"], ["f"], ["a", "b", "c"], F.col("hard"), block).collect()}
    axes = lambda r: None if None in r[2:6] else (float(r[2]), *(min(v, 0.0) for v in r[3:6]))
    live = [r for r in rows if r[6]]
    beaten = lambda r: axes(r) and any(s[1] == r[1] and axes(s) and axes(s) != axes(r) and all(p >= q for p, q in zip(axes(s), axes(r))) for s in live)
    assert got == {r[0] for r in live if not beaten(r)}


def test_pareto_keeps_rows_that_cannot_be_compared(spark):
    df = spark.createDataFrame([("g", 1, 5.0), ("g", 2, 5.0), ("g", None, 1.0), ("g", 1, None)], "g string, less long, more double")
    assert sorted(map(tuple, tables.pareto(df, "g", "less", "more").collect()), key=str) == sorted([("g", 1, 5.0), ("g", None, 1.0), ("g", 1, None)], key=str)


def test_beam_roles_and_repeated_geometry(spark):
    rows = [("s", "p", 0, 1.0, [], -0.0, "a"), ("s", "q", 1, 9.0, ["side"], -1.0, "b"), ("s", "r", 2, 8.0, ["side", "G1"], -3.0, "c"), ("s", "t", 3, None, None, None, "d"), ("u", "p", 0, None, ["G1"], -1.0, "a")]
    df = spark.createDataFrame(rows, "s string, geometry string, n long, score double, violated array<string>, m double, asset string")
    got = skyline.beam(df, ["s"], "geometry", "n", "score", "violated", ["m"], "asset", ["side", "G1"]).collect()
    assert sorted((r.s, r.place, r.role, r.geometry) for r in got) == [("s", 0, "global_best", "p"), ("s", 1, "side_champion", "q"), ("s", 2, "G1_champion", "r"), ("u", 0, "global_best", "p")]


# nested records


def first_difference(a, b, path="$"):
    if type(a) is not type(b):
        return path
    if isinstance(a, dict):
        if set(a) != set(b):
            return path
        return next((d for k in sorted(a) if (d := first_difference(a[k], b[k], f"{path}.{k}"))), None)
    if isinstance(a, list):
        if len(a) != len(b):
            return path
        return next((d for i, (x, y) in enumerate(zip(a, b)) if (d := first_difference(x, y, f"{path}[{i}]"))), None)
    return None if a == b else path


def test_json_paths_equal_a_recursive_comparison(spark):
    rng = random.Random(9)

    def value(depth):
        kind = rng.randint(0, 6 if depth else 3)
        if kind < 4:
            return rng.choice([None, True, 3, 2.5, "x", "y,z", ""])
        return [value(depth - 1) for _ in range(rng.randint(0, 3))] if kind == 4 else {rng.choice("abcd"): value(depth - 1) for _ in range(rng.randint(0, 3))}

    def change(v):
        if rng.random() < 0.15:
            return value(1)
        if isinstance(v, dict):
            return {k: change(x) for k, x in v.items()}
        return [change(x) for x in v] if isinstance(v, list) else v

    pairs = [(i, v, change(v)) for i, v in enumerate({"k": value(3), "run": i} for i in range(120))]
    a = spark.createDataFrame([(i, json.dumps(v)) for i, v, _ in pairs], "i long, j string")
    b = spark.createDataFrame([(i, json.dumps(w if isinstance(w, dict) else {"k": w})) for i, _, w in pairs], "i long, j string")
    got = {r.i: r.path for r in nested.json_diff(a, b, "i", "j", ["run"]).collect()}
    strip = lambda v: {k: x for k, x in (v if isinstance(v, dict) else {"k": v}).items() if k != "run"}
    want = {i: p for i, v, w in pairs if (p := first_difference(strip(v), strip(w)))}
    assert got == want and len(want) > 30


def test_columns_of_one_side_and_repeated_keys_are_reported(spark):
    a = spark.createDataFrame([(1, 2, 3), (2, 0, 0), (None, 1, 1), (4, 0, 0), (4, 0, 0)], "k long, x long, y long")
    b = spark.createDataFrame([(1, 2), (3, 0), (None, 1), (4, 0)], "k long, x long")
    got = {r.k: (r.state, [tuple(d) for d in r.differences]) for r in nested.record_diff(a, b, "k").collect()}
    keys = ("differs", [("$", "keys", "y", "")])
    assert got == {1: keys, None: keys, 2: ("left_only", []), 3: ("right_only", []), 4: ("repeated", [])}
    assert {r.k: r.state for r in tables.dataset_diff(a.where("k = 1"), b.where("k = 1"), "k", []).collect()} == {1: "differs"}
    assert {r.k: r.state for r in tables.dataset_diff(a.where("k = 1"), b.where("k = 1"), "k", ["y"]).collect()} == {1: "equal"}


def test_differences_through_structs_arrays_and_maps(spark):
    kind = "k long, s struct<a:array<struct<b:double,t:string>>,m:map<string,int>,t:string>"
    left = spark.createDataFrame([(1, ([(1.0, "x"), (2.0, "y")], {"p": 1, "t": 5}, "v")), (2, (None, {}, None)), (3, ([], {"p": 1}, "v")), (4, None)], kind)
    right = spark.createDataFrame([(1, ([(1.0, "z"), (2.5, "y")], {"p": 2, "t": 6}, "w")), (2, ([], {}, None)), (3, ([], {"q": 1}, "w")), (4, None)], kind)
    got = {r.k: [(d.path, d.what) for d in r.differences] for r in nested.record_diff(left, right, "k", ["t"]).collect()}
    assert got == {1: [("$.s.a[1].b", "value"), ("$.s.m.p", "value")], 2: [("$.s.a", "null")], 3: [("$.s.m", "keys")], 4: []}
    matrix = {(r.path, r.what): (r.n, r.n_rows) for r in nested.mismatch_matrix(nested.record_diff(left, right, "k", ["t"]), "k").collect()}
    assert matrix[("$.s.a[].b", "value")] == (1, 1)


# chains


def moves(spark, pairs, inventory, prior):
    m = spark.createDataFrame([(a, b, h, ok) for a, b, h, ok in pairs], "src string, dst string, hash string, verified boolean")
    rows = lambda x: spark.createDataFrame(x, "path string, hash string")
    return {r.path: (r.final, r.hops, r.state) for r in chains.resolve_chain(rows(prior), m, rows(inventory)).collect()}


def test_chains_of_any_length_and_cycles(spark):
    long = [(f"p{i}", f"p{i + 1}", "h", True) for i in range(70)]
    ring = [("c0", "c1", "h", True), ("c1", "c2", "h", True), ("c2", "c0", "h", True), ("into", "in2", "h", True)]
    other = [("in2", "gone", "h", True), ("u0", "u1", "h", False), ("w0", "w1", "h", True), ("w0", "w2", "h", True), ("x0", "y", "h", True), ("x1", "y", "h", True), ("e0", "../e1", "h", True), ("d0", "d1", "g", True)]
    prior = [(p, "h") for p in ("p0", "p5", "p70", "c0", "c2", "into", "u0", "w0", "x0", "e0", "d0", "there")]
    got = moves(spark, long + ring + other, [("p70", "h"), ("there", "z"), ("u1", "h"), ("w1", "h"), ("y", "h"), ("../e1", "h"), ("d1", "h")], prior)
    assert got["p0"] == ("p70", 70, "excused") and got["p5"] == ("p70", 65, "excused") and got["p70"] == ("p70", 0, "present")
    assert got["c0"] == got["c2"] == (None, None, "cycle")
    assert got["into"] == ("gone", 2, "missing") and got["there"] == ("there", 0, "present")
    assert all(got[p][2] == "missing" and got[p][1] == 0 for p in ("u0", "w0", "x0", "e0", "d0"))


FINE = {"prior_move": "a", "prior_destination": "data/a", "prior_path": "x.bin", "successor_manifest": "m", "successor_move": "s", "successor_source": "data/a/x.bin", "successor_destination": "data/b/x.bin", "size": "1", "sha": "h"}
CASES = {
    "": {}, "FIELD_MISSING": {"map": {"sha": None}}, "PATH_ESCAPE": {"map": {"successor_destination": "../x.bin"}}, "PRIOR_MOVE_UNKNOWN": {"map": {"prior_move": "z"}}, "PRIOR_DESTINATION": {"map": {"prior_destination": "data/q", "successor_source": "data/q/x.bin"}},
    "PRIOR_FILE_UNKNOWN": {"map": {"prior_path": "y.bin", "successor_source": "data/a/y.bin"}}, "PRIOR_HASH_MISSING": {"prior": {"sha": None}}, "PRIOR_SIZE": {"prior": {"size": "9"}}, "PRIOR_SHA256": {"prior": {"sha": "g"}}, "SUCCESSOR_SOURCE": {"map": {"successor_source": "data/c/x.bin"}},
    "SUCCESSOR_MANIFEST_UNKNOWN": {"map": {"successor_manifest": "n"}}, "SUCCESSOR_MOVE_UNKNOWN": {"map": {"successor_move": "t"}}, "SUCCESSOR_NOT_VERIFIED": {"next": {"verified_at": None}}, "SUCCESSOR_ROW_SOURCE": {"next": {"source": "q"}}, "SUCCESSOR_ROW_DESTINATION": {"next": {"destination": "q"}},
    "SUCCESSOR_PRE_HASH": {"next": {"sha": "g"}}, "DESTINATION_MISSING": {"there": {"path": "q"}}, "DESTINATION_SIZE": {"there": {"size": "9"}}, "DESTINATION_SHA256": {"there": {"sha": "g"}}, "SEVERAL_MAPPINGS_OF_A_FILE": {"twice": True}, "DESTINATION_OF_SEVERAL_FILES": {"twice": True}, "STILL_AT_PRIOR_DESTINATION": {"still": True},
}


def test_each_rule_of_successors_has_its_name(spark):
    maps, prior, later, there = [], [], [], []
    for i, c in enumerate(CASES.values()):
        own = lambda row: {k: v if v is None or k in ("size", "sha", "status", "verified_at") else f"{v[:3]}{i}{v}" if v.startswith("../") else f"{i}{v}" for k, v in row.items()}  # noqa: B023,E731
        fine = FINE | c.get("map", {})
        maps += [own(fine)] * (2 if c.get("twice") else 1)
        prior.append(own({"move": "a", "destination": "data/a", "path": "x.bin", "size": "1", "sha": "h"} | c.get("prior", {})))
        later.append(own({"manifest": "m", "move": "s", "source": "data/a/x.bin", "destination": "data/b/x.bin", "status": "MOVED", "verified_at": "now", "sha": "h"} | c.get("next", {})))
        there.append(own({"path": "data/b/x.bin", "size": "1", "sha": "h"} | c.get("there", {})))
        if c.get("still"):
            there.append(own({"path": "data/a/x.bin", "size": "1", "sha": "h"}))
    # a source is the destination and the path, which here both carry the number
    for m in maps:
        i = m["prior_path"].split("x.bin")[0].split("y.bin")[0]
        if m["successor_source"] == f"{i}data/a/x.bin":
            m["successor_source"] = f"{i}data/a/{i}x.bin"
        m["successor_source"] = m["successor_source"].replace(f"{i}data/a/y.bin", f"{i}data/a/{i}y.bin").replace(f"{i}data/q/x.bin", f"{i}data/q/{i}x.bin")
    for row in later:
        i = row["move"][:-1]
        row["source"] = row["source"].replace(f"{i}data/a/x.bin", f"{i}data/a/{i}x.bin")
    for row in there:
        i = row["path"].split("data")[0]
        row["path"] = row["path"].replace("/a/x.bin", f"/a/{i}x.bin")
    frame = lambda rows, kind: spark.createDataFrame([tuple(r[c.split()[0]] for c in kind.split(", ")) for r in rows], kind)
    kinds = [", ".join(f"{c} string" for c in x) for x in (chains.REQUIRED, ["move", "destination", "path", "size", "sha"], ["manifest", "move", "source", "destination", "status", "verified_at", "sha"], ["path", "size", "sha"])]
    got = chains.successor_issues(*(frame(r, k) for r, k in zip((maps, prior, later, there), kinds))).collect()
    by = {r.prior_path.split("x.bin")[0].split("y.bin")[0]: r.issues for r in got}
    for i, name in enumerate(CASES):
        assert (name in by[str(i)]) if name else by[str(i)] == [], (name, by[str(i)])


def test_the_head_of_a_chain_is_bound():
    assert chains.ledger_issues(("a.json", "1"), ("a.json", "1"), [("b.json", "2", "2")]) == []
    assert chains.ledger_issues(("a.json", "1"), ("c.json", "9"), [("a.json", None, "1"), ("b.json", "3", "2")]) == ["PRIOR_MANIFEST_SHA256", "PRIOR_MANIFEST_PATH", "LEDGER_CYCLE", "SUCCESSOR_MANIFEST_SHA256"]
    assert chains.ledger_issues(("a.json", "1"), ("", ""), []) == ["PRIOR_MANIFEST_UNBOUND", "NO_SUCCESSOR_MANIFEST"]


# logs


def test_a_log_in_many_splits_has_the_numbers_of_one(spark, tmp_path):
    rng = random.Random(1)
    lines = {f"{n}.log": [("Error " if rng.random() < 0.1 else "fine ") + "x" * rng.randint(0, 80) for _ in range(3000)] for n in "ab"}
    for name, x in lines.items():
        (tmp_path / name).write_text("\n".join(x))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        got = sorted((r.file[-5:], r.line_no, r.line) for r in files.scan_logs(spark, str(tmp_path), ["ERROR", "nothing"]).collect())
        assert got == sorted((n, i, x) for n, own in lines.items() for i, x in enumerate(own, 1) if x.startswith("Error"))
        records = [json.dumps({"k": rng.randint(0, 40), "v": i}) if rng.random() < 0.95 else "{broken" for i in range(2000)]
        (tmp_path / "r").mkdir()
        (tmp_path / "r" / "1.jsonl").write_text("\n".join(records[:1200]))
        (tmp_path / "r" / "2.jsonl").write_text("\n".join(records[1200:]))
        last = {json.loads(x)["k"]: json.loads(x)["v"] for x in records if x[-1] == "}"}
        assert {r.k: r.v for r in files.latest_records(spark, f"{tmp_path}/r", "k long, v long", ["k"]).collect()} == last
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


# shapes


def plain_hull(points):
    p = sorted({(round(x, 6), round(y, 6)) for x, y in points})
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

    def half(pts):
        out = []
        for q in pts:
            while len(out) > 1 and turn(out[-2], out[-1], q) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return half(p) + half(p[::-1]) if len(p) > 2 else []


def plain_area(p):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1]))) / 2 if len(p) > 2 else 0.0


def plain_clip(p, w, h):
    for k, sign, at in ((0, 1, 0), (0, -1, w), (1, 1, 0), (1, -1, h)):
        out = []
        for a, b in zip(p, p[1:] + p[:1]):
            da, db = sign * (a[k] - at), sign * (b[k] - at)
            out += [a] * (da >= 0)
            if (da >= 0) != (db >= 0):
                t = da / (da - db)
                out.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
        p = out
    return p


def test_hulls_of_random_points(spark):
    rng = random.Random(6)
    point = lambda: [rng.choice([rng.uniform(-60, 160), float(rng.randint(0, 5))]), rng.choice([rng.uniform(-60, 160), float(rng.randint(0, 5))])]
    sets = [[point() for _ in range(rng.randint(1, 9))] for _ in range(200)] + [[[0.0, 0.0]] * 4, [[0.0, 0.0], [1.0, 1.0], [2.0, 2.0]], [[500.0, 500.0], [600.0, 500.0], [500.0, 600.0]]]
    df = spark.createDataFrame(list(enumerate(sets)), "i long, p array<array<double>>")
    got = {r.i: r.h for r in df.select("i", polygons.hull_in_image(F.col("p"), 100.0, 80.0).alias("h")).collect()}
    for i, s in enumerate(sets):
        h = plain_hull(s)
        clipped = plain_clip(h, 100.0, 80.0) if len(h) > 2 else []
        assert math.isclose(got[i].area, plain_area(h), abs_tol=1e-5), (i, s)
        assert math.isclose(got[i].clipped, plain_area(clipped), abs_tol=1e-5), (i, s)
        if plain_area(clipped) > 1e-3:
            xs, ys = [q[0] for q in clipped], [q[1] for q in clipped]
            assert math.isclose(got[i].iou, plain_area(clipped) / ((max(xs) - min(xs)) * (max(ys) - min(ys))), rel_tol=1e-5)
    bad = spark.createDataFrame([([[0.0, float("nan")], [1.0, 0.0], [0.0, 1.0]],), ([[0.0, None], [1.0, 0.0]],), (None,)], "p array<array<double>>")
    assert all(r.h is None for r in bad.select(polygons.hull_in_image(F.col("p"), 9.0, 9.0).alias("h")).collect())


def test_boxes_in_any_order(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(60):
        q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        size, centre = rng.uniform(0.5, 3, 3), rng.normal(size=3) * 4
        signs = np.array(list(itertools.product((-1, 1), repeat=3)))
        eye = q @ (rng.normal(size=3) * 6)
        order = rng.permutation(8)
        own = q.T @ eye
        shown = [bool(any(abs(own[k]) > size[k] / 2 and np.sign(own[k]) == s[k] for k in range(3))) for s in signs[order]]
        rows.append((i, ((signs[order] * size / 2) @ q.T + centre).tolist(), (eye + centre).tolist(), shown))
    df = spark.createDataFrame(rows, "i long, p array<array<double>>, eye array<double>, shown array<boolean>")
    got = df.withColumn("got", cuboids.visible_corners(F.col("p"), F.col("eye"))).collect()
    assert all(list(r.got) == list(r.shown) for r in got)
    skew = spark.createDataFrame([([[float(x + 0.5 * z), float(y), float(z)] for x, y, z in itertools.product((0, 1), repeat=3)],), ([[0.0, 0.0, 0.0]] * 8,)], "p array<array<double>>")
    assert all(r.a is None for r in skew.select(cuboids.box_axes(F.col("p")).alias("a")).collect())


# densities, choices


def test_binned_density_is_near_the_direct_one(spark):
    rng = np.random.default_rng(1)
    x, y = rng.uniform(0, 10, 400), np.clip(rng.normal(5, 1.5, 400), 0, 10)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    for circular in (False, True):
        got = {(round(r.gx, 4), round(r.gy, 4)): r.density for r in density.kde2d(df, "x", "y", (0, 10, 0, 10), 9, bins=256, circular=circular).collect()}
        hx, hy = x.std() * 400 ** (-1 / 6), y.std() * 400 ** (-1 / 6)
        g = np.linspace(0, 10, 9)
        k = lambda v, h, images: sum(np.exp(-0.5 * ((g[:, None] - z[None]) / h) ** 2) for z in images(v))
        mirror = lambda v: (v, -v, 20 - v)
        d = k(x, hx, (lambda v: (v, v - 10, v + 10)) if circular else mirror) @ k(y, hy, mirror).T
        d /= d.sum()
        assert max(abs(got[(round(a, 4), round(b, 4))] - d[i, j]) for i, a in enumerate(g) for j, b in enumerate(g)) < 2e-4


def test_shares_do_not_depend_on_the_order_of_rows(spark):
    df = spark.range(3200).select((F.col("id") % 51).cast("int").alias("s"))
    from lodestat.operators.evaluation import conditioned_share

    run = lambda n: sorted(map(tuple, conditioned_share(df.repartition(n), [F.col("s") >= e for e in (0, 10, 20, 30, 40)], F.least(F.floor(F.col("s") / 10), F.lit(4)), [0.1, 0.2, 0.3, 0.2, 0.2]).collect()))
    assert run(1) == run(7)
    assert conditioned_share(df.limit(0), [F.col("s") >= 0], F.lit(0), [1.0]).count() == 0


def test_maximin_takes_text_keys(spark):
    rows = [(f"k{i}", float(i * i)) for i in range(12)]
    got = choices.maximin(spark.createDataFrame(rows, "k string, x double"), "k", [F.col("x")], 3).collect()
    assert {r.k for r in got} >= {"k11"} and len(got) == 3
