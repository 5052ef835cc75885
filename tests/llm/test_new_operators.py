"""Conversation repair, prefix trie and personal data against brute force and odd tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import cache

import duckdb
import numpy as np
import pytest

pytest.importorskip("lodestat.llm")

from lodestat.llm import pii, prefix_trie, turn_repair  # noqa: E402
from lodestat.llm import queries as registered  # noqa: E402

SCHEMA = "conv_id long, turn long, role string, text string, n_words long, kind string"


@pytest.fixture
def many_parts(spark):
    """Seven shuffle partitions that are not merged, so that conversations lie across range boundaries."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def talks(seed, n=60, long=150):
    """Rows with nulls, ties, repeats, unknown roles, blank and unfinished texts, and one conversation that holds most rows."""
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "why", "", "  \n", "Well?", None, "A longer one, with é and \U0001f600.", "cut off "]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    rows = []
    for c in [*range(n), None, -3]:
        size = long if c == 10 else rng.randint(1, 7)
        for t in range(size):
            turn = None if rng.random() < 0.05 else t + 3 * (rng.random() < 0.1)
            text = f"Turn {t}." if c == 10 and rng.random() < 0.8 else rng.choice(texts)
            role = ("user", "assistant")[t % 2] if rng.random() < 0.7 else rng.choice(roles)
            rows.append((c, turn, role, text, 7, "x"))
    return rows + rows[:5]


def md5(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


# 11


def repaired_by_force(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit and hash of (turn, role, text), by plain recursion."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, md5(r[1], r[2])))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\f\r")
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    made = {"": "u", "s": "u", "u": "a", "a": "u"}

    @cache
    def best(i, state, inserted):
        options = [(0, "")] if i == len(rows) and state in ("", "a") else []
        if inserted < 2:  # three in a row only go round
            c, a = best(i, made[state], inserted + 1)
            options.append((c + 2, "I" + a))
        if i < len(rows):
            fault, initial = faults[i], rows[i][1][:1]
            c, a = best(i + 1, state, 0)
            options.append((c + 3, "D" + a))
            if fault not in ("b", "d"):
                more = fault == "t"
                c, a = best(i + 1, made[state], 0)
                options.append((c + 2 + more, "R" + a))
                if (state, initial) in after:
                    c, a = best(i + 1, after[state, initial], 0)
                    options.append((c + more, "K" + a))
        return min(options, default=(10**9, ""))

    cost, audit = best(0, "", 0)
    out, state, i = [], "", 0
    for e in audit:
        if e == "K":
            state = after[state, rows[i][1][0]]
            out.append(f"{rows[i][1]}:{rows[i][2]}")
        elif e in "RI":
            state = made[state]
            out.append({"u": "user", "a": "assistant"}[state] + ":" + (rows[i][2] if e == "R" else ""))
        i += e != "I"
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows[:-1], rows[1:])]
    counts = [faults.count(x) for x in "bdt"]
    return (gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def damaged_by_force(rows):
    by = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        by[c] += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return by


FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_equals_brute_force_across_range_boundaries(many_parts, seed):
    rows = talks(seed)
    df = many_parts.createDataFrame(rows, SCHEMA).repartition(5)
    got = turn_repair.repair(turn_repair.damage(df), df).collect()
    by = damaged_by_force(rows)
    assert len(got) == len({r[0] for r in rows})
    for r in got:
        assert tuple(r[f] for f in FIELDS) == repaired_by_force(by[r.conv_id]), r.conv_id


def test_a_conversation_of_all_rows_is_solved_in_parts(many_parts):
    rows = talks(5, n=1, long=5)[:0] + [(1, t, ("user", "assistant")[t % 3 % 2], f"Turn {t % 50}" + "." * (t % 7 > 0), 0, "x") for t in range(400)]
    df = many_parts.createDataFrame(rows, SCHEMA)
    _, headers = turn_repair.plan(df)
    assert headers.count() > 3
    (got,) = turn_repair.repair(df).collect()
    import sys

    sys.setrecursionlimit(10000)
    assert tuple(got[f] for f in FIELDS) == repaired_by_force([r[1:4] for r in rows])


def test_repaired_turns_are_the_hashed_ones(many_parts):
    df = many_parts.createDataFrame(talks(3), SCHEMA)
    lines = defaultdict(list)
    for r in sorted(turn_repair.repaired_turns(df).collect(), key=lambda r: r.turn):
        lines[r.conv_id].append(f"{r.role}:{r.text}")
        assert r.edit in "KRI"
    for r in turn_repair.repair(df).collect():
        assert r.repaired_sha256 == hashlib.sha256("\n".join(lines[r.conv_id]).encode()).hexdigest()
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines[r.conv_id]))


def test_repair_of_empty_tables_and_of_conversations_without_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi.", 0, "x"), (2, None, None, None, 0, "x")], SCHEMA)
    assert turn_repair.repair(df.limit(0)).count() == 0
    assert turn_repair.repaired_turns(df.limit(0)).count() == 0
    got = {r.conv_id: r for r in turn_repair.repair(df.where("conv_id = 1"), df).collect()}
    assert got[2].audit == "" and got[2].cost == 0 and got[2].repaired_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[1].audit == "KI"


# 12


def trie_by_force(by, ids):
    members = defaultdict(list)
    for c in ids:
        for d in range(len(by[c]) + 1):
            members[tuple(by[c][:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(by[c]) == len(p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def turns_by_force(rows):
    by = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            by[c].append((turn, role or "", text or ""))
    return {c: [r[1:] for r in sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, md5(*r[1:])))] for c, v in by.items()}


def rebuilt_by_force(rows):
    own, out = turns_by_force(rows), {}
    for c in own:
        h, source = zlib.crc32(str(c).encode()) % 9, c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = own.get(source, [])[:h] + own[c][h:]
    return out


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes_of(df):
    return sorted((tuple(r[c] for c in NODE) for r in df.collect()), key=str)


@pytest.mark.parametrize("heavy", [1, 2, 5, 1000])
def test_trie_equals_brute_force_with_every_cut(many_parts, heavy, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SHARD_NODES", 4)
    rows = [r for r in talks(7, long=40) if r[0] != -3]
    rows += [(100 + i, t, "user", f"shared {t}", 0, "x") for i in range(12) for t in range(9)]
    df = many_parts.createDataFrame(rows, SCHEMA).repartition(3)
    got = nodes_of(prefix_trie.prefix_trie(*prefix_trie.rebuild(prefix_trie.turns(df)), heavy=heavy))
    by = rebuilt_by_force(rows)
    assert got == sorted(trie_by_force(by, by), key=str)


def test_trie_of_odd_tables(spark):
    df = spark.createDataFrame([(None, 0, "user", "left out", 0, "x"), (5, None, None, None, 0, "x"), (5, None, None, None, 0, "x"), (-3, 1, "", "é", 0, "x")], SCHEMA)
    make = lambda d: prefix_trie.prefix_trie(*prefix_trie.rebuild(prefix_trie.turns(d)))
    by = rebuilt_by_force([tuple(r) for r in df.collect()])
    assert nodes_of(make(df)) == sorted(trie_by_force(by, by), key=str)
    assert make(df.limit(0)).count() == 0


def test_slot_table_is_minimal_and_knows_its_keys():
    rng = np.random.default_rng(3)
    hi, lo = rng.integers(0, 1 << 63, (2, 20000)).astype(np.uint64)
    table = prefix_trie.SlotTable(hi[:10000], lo[:10000])
    assert sorted(table.slots(hi[:10000], lo[:10000])) == list(range(10000))
    assert (table.slots(hi[10000:], lo[10000:]) == -1).all()
    assert (table.slots(hi[:10000], lo[:10000] ^ np.uint64(1)) == -1).all()
    with pytest.raises(ValueError):
        prefix_trie.SlotTable(hi[[0, 0]], lo[[0, 0]])


@pytest.mark.parametrize("name", ["op11_turn_repair", "op12_prefix_trie"])
def test_sql(spark, data, name):
    df = registered.queries()[name](spark, data)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{data}/conversations.parquet'")
    want = con.execute(registered.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == sorted(want.fetchall(), key=str)


# 13

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def base_by_force(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
            if kind == 1 and any(int(x) > 255 for x in m.group().split(".")) or kind == 2 and not (14 <= len(d) <= 19 and total % 10 == 0) or kind == 3 and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return [(a, b, k) for a, k, b in sorted(out)]


def test_base_spans_equal_the_patterns(documents_text):
    rng = random.Random(1)
    for text in documents_text + ["".join(rng.choice("0123456789012345678901234..+-() @ab@b_%é,") for _ in range(rng.randint(1, 40))) for _ in range(20000)]:
        assert pii.base_spans(text) == base_by_force(text), text


@pytest.fixture(scope="module")
def documents_text(spark, data):
    return [r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]


@pytest.mark.parametrize("text", ["a" * 400000, "a" * 200000 + "@", "1" * 400000, "1." * 200000, "+1" + " " * 300000, "@" * 300000, "1 " * 20000, "a@" * 100000, " at " * 50000])
def test_time_is_linear_in_a_text(text):
    import time

    t = time.time()
    pii.find_spans(text, np.zeros(1 << pii.BITS))
    assert time.time() - t < 30


def test_best_labelling_and_training_equal_enumeration():
    rng = np.random.default_rng(5)
    for _ in range(200):
        segments = sorted((int(e), int(s), 0, float(rng.normal())) for s, e in [sorted(rng.choice(9, 2, False)) for _ in range(7)])
        best = 0.0
        for mask in range(1 << len(segments)):
            chosen = sorted((s, e) for i, (e, s, _, _) in enumerate(segments) if mask >> i & 1)
            if all(a[1] <= b[0] for a, b in zip(chosen[:-1], chosen[1:])):
                best = max(best, sum(x[3] for i, x in enumerate(segments) if mask >> i & 1))
        got = pii.best_labelling(segments)
        assert all(a[1] <= b[0] for a, b in zip(got[:-1], got[1:]))
        assert np.isclose(sum(max(x[3] for x in segments if (x[1], x[0]) == (s, e)) for s, e, _ in got), best)


def test_hidden_forms_are_found_and_decoys_left(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8)))

    def card():
        d = "4" + "".join(str(rng.randint(0, 9)) for _ in range(14))
        return next(d + str(c) for c in range(10) if pii.luhn(d + str(c)))

    spans = [lambda: f"{word()}.{rng.randint(10, 99)}@mail.{word()}.com", lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), card, lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"]
    train = [" ".join([word() for _ in range(12)] + [spans[i % 4]()] + [word() for _ in range(12)]) for i in range(240)]
    schema = "doc_id long, text string, n_email long"
    weights = pii.learn(spark.createDataFrame(list(enumerate(train, 1)), "doc_id long, text string"))
    rows, golds = [], []
    for i in range(200):
        kind = i % 4
        form, good = pii._forms(kind, spans[kind](), np.random.default_rng(i))[i // 4 % 4]
        before = " ".join(word() for _ in range(8)) + " "
        rows.append((i, before + form + " " + word() + ".", 1))
        golds.append((form, good, f"{pii.KINDS[kind]}:{len(before)}:{len(before) + len(form)}"))
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, schema), weights).collect()}
    right = sum((gold in got[i].spans.split(",")) if good else (gold not in got[i].spans.split(",")) for i, (_, good, gold) in enumerate(golds))
    assert right >= 185
    clean = spark.createDataFrame([(i, " ".join(word() for _ in range(40)) + f" {i} {1900 + i}-0{i % 9 + 1}-11 at {word()} {i}.{i}.", 1) for i in range(100)], schema)
    assert all(r.spans == "" for r in pii.personal_data(clean, weights).collect())


def test_odd_documents(spark):
    rows = [(None, None, 3), (1, "", 3), (1, "a@b.co 1.2.3.4", 3), (1, "a@b.co 1.2.3.4", 3), (2, "é\U0001f600 4111111111111111@x.com " + "word " * 20000 + "+1 (743) 555-3824", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_email long")
    got = pii.personal_data(df)
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    by = sorted((tuple(r) for r in got.collect()), key=str)
    assert len(by) == 5 and sum(r[6] == "email:0:6,ip:7:14" for r in by) == 2
    assert [r[6] for r in by if r[0] == 2] == ["email:3:25,card:3:19,phone:100026:100043"]
    assert all(r[6] == "" and r[5] == hashlib.sha256(b"").hexdigest() for r in by if r[1] == 0)
    assert pii.personal_data(df.limit(0)).count() == 0
    assert pii.personal_data(spark.createDataFrame([(1, "no data here", 1)], "doc_id long, text string, n_email long")).first().spans == ""


def test_base_columns_of_the_query(spark, data, documents_text):
    got = registered.queries()["op13_pii"](spark, data).collect()
    said = lambda spans: ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, b, k in spans)
    want = sorted(hashlib.sha256(said(base_by_force(t)).encode()).hexdigest() for t in documents_text)
    assert sorted(r.base_sha256 for r in got) == want
