"""Repair of conversation structure: the cheapest edits that make the roles of a conversation read (system)? (user assistant)+, or nothing.

Rows of a conversation are taken by turn (nulls first, rows of one turn by the MD5 of role and text). Each has its first fault: blank (no
character but white space), duplicate (role and text seen earlier in the conversation), truncated (does not end in . ! ?). Keep costs 0,
Rerole to user or assistant 2, Delete 3, Insert of an empty user or assistant turn 2; a truncated row that stays adds 1. Blank and duplicate
rows must go. A row whose role begins with none of s, u, a cannot be kept. Of the cheapest audits (the initials of the edits in order) the
ASCII-least is taken.

Method. A state is where the roles stand: at the start, after system, after user, after assistant. A node is a row's place and a state; its
cost to go is a (min, +) product of 4 x 4 matrices, computed by a doubling scan over the rows. The arcs that attain it are ranked by the
audits that begin with them, of length 1, 2, 4, ...: the rank of twice the length is that of the pair (own rank, rank of the arc to which
the doubled pointer leads). The first arc is the one of least rank, and the pointers, taken from the shortest, list the path in order.
Labels of arcs out of one node differ, so a pointer is settled by the first letter.

Scale. Rows are dealt to range partitions by (conversation, place); a group in Python is a partition's rows without their texts. A
conversation cut by a boundary is solved in parts: each part gives its matrix, the later parts' product is the part's cost at its end, its
exits for each state of entry are found, and entries follow one after another. There are fewer such parts than two a partition. Texts move
in two shuffles and are hashed as a stream, so no conversation is held as a whole; only its audit is, as the result needs it.

Nulls: a null role or text counts as one space, a null turn comes first, null conv_ids are one conversation. An empty table gives no rows.
Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.llm.common import crc_sql, materialize
from lodestat.operators.ranges import AT, PART, in_order, same

WHITE = " \t\n\x0b\f\r"
START, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 40
#: The state after the next role that may be made up: user, but assistant after user.
NEXT = np.array([USER, USER, ASSISTANT, USER])
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: The state after a kept row, by the initial of its role (s, u, a, other) and the state before; -1: it may not be kept.
KEPT = np.array([[SYSTEM, -1, -1, -1], [USER, USER, -1, USER], [-1, -1, ASSISTANT, -1], [-1, -1, -1, -1]])
#: Whether the second initial may follow the first: su, ua, au.
LEGAL = np.array([[0, 1, 0, 0], [0, 0, 1, 0], [0, 1, 0, 0], [0, 0, 0, 0]], bool)
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
LETTERS = np.frombuffer(b"DIKR", np.uint8)
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4  # in the order of their letters; 0 is the end


def damage(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults put in by crc32(`conv_id:turn`) % 20: 0 drops the row, 1 empties its text, 2 removes its
    [.!?], 3 repeats it, 4 makes its role user. Nulls of role and text, and in the hashed text, become one space."""
    say = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(say("conv_id"), F.lit(":"), say("turn")).cast("binary")) % 20
    rows = df.select("conv_id", "turn", say("role").alias("role"), say("text").alias("text"), kind.alias("_k")).where("_k <> 0")
    text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    twice = F.explode(F.when(F.col("_k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("_k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), twice.alias("_copy")).drop("_copy")


# the search, on the rows of one partition


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(min, +) product of stacks of 4 x 4 matrices."""
    out = a[:, :, 0, None] + b[:, None, 0, :]
    for k in (1, 2, 3):
        np.minimum(out, a[:, :, k, None] + b[:, None, k, :], out)
    return np.minimum(out, FAR)


def _apply(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.minimum((a + v[:, None, :]).min(2), FAR)


_INSERTS = np.array([[0, FAR, 2, 4], [FAR, 0, 2, 4], [FAR, FAR, 0, 2], [FAR, FAR, 2, 0]])
#: The cost at the end of a conversation: inserts up to a state in which it may end.
END = np.array([0, 4, 2, 0])


def _steps() -> np.ndarray:
    """(initial, fault, from, to): the cost of a row with the inserts before it."""
    out = np.full((4, 4, 4, 4), FAR)
    for initial in range(4):
        for fault in range(4):
            for q in range(4):
                out[initial, fault, q, q] = 3
                if fault in (FINE, TRUNCATED):
                    more = int(fault == TRUNCATED)
                    out[initial, fault, q, NEXT[q]] = min(out[initial, fault, q, NEXT[q]], 2 + more)
                    if KEPT[initial, q] >= 0:
                        out[initial, fault, q, KEPT[initial, q]] = min(out[initial, fault, q, KEPT[initial, q]], more)
    return _product(np.broadcast_to(_INSERTS, (16, 4, 4)), out.reshape(16, 4, 4)).reshape(4, 4, 4, 4)


STEPS = _steps()


def to_end(initial: np.ndarray, fault: np.ndarray, part: np.ndarray) -> np.ndarray:
    """For each row the product of the matrices of the rows from it to the end of its part (the rows with one number, in order)."""
    m, n, shift = STEPS[initial, fault], len(part), 1
    while shift < n and (inside := np.flatnonzero(part[:-shift] == part[shift:])).size:
        m[inside] = _product(m[inside], m[inside + shift])
        shift *= 2
    return m


def least_paths(initial: np.ndarray, fault: np.ndarray, part: np.ndarray, tails: np.ndarray, final: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(part, letter, exit, cost): the letters of the least audits of all parts one after another, with their part's number, and for each
    part the state after it and the cost from its entry. tails: the cost at the end of each part; final: whether the part ends there."""
    n, parts = len(part), len(tails)
    first = np.searchsorted(part, np.arange(parts))
    last_layer = np.append(first[1:], n) + np.arange(parts)  # a part has one more layer of nodes than rows
    layer = np.arange(n) + part
    cost = np.empty((n + parts, 4), np.int64)
    cost[layer] = _apply(to_end(initial, fault, part), tails[part])
    cost[last_layer] = tails
    cost = cost.ravel()

    froms, labels, tos = [], [], []

    def add(where: np.ndarray, source: np.ndarray, label: int, price: np.ndarray | int, target: np.ndarray) -> None:
        good = where & (cost[source] == price + cost[target])
        froms.append(source[good]), tos.append(target[good])
        labels.append(np.full(int(good.sum()), label))

    free = (fault == FINE) | (fault == TRUNCATED)
    more, always = (fault == TRUNCATED).astype(np.int64), np.ones(n, bool)
    for q in range(4):
        here = 4 * layer + q
        kept = KEPT[initial, q]
        add(always, here, DELETE, 3, here + 4)
        add(always, here, INSERT, 2, 4 * layer + NEXT[q])
        add(free & (kept >= 0), here, KEEP, more, 4 * (layer + 1) + np.maximum(kept, 0))
        add(free, here, REROLE, 2 + more, 4 * (layer + 1) + NEXT[q])
        add(final, 4 * last_layer + q, INSERT, 2, 4 * last_layer + NEXT[q])
    source, label, target = (np.concatenate(x) for x in (froms, labels, tos))
    order = np.lexsort((label, source))
    source, label, target = source[order], label[order], target[order]
    arcs = len(source)

    head = np.full(len(cost), arcs)  # the least arc out of a node; `arcs` stands for the end
    nodes, at = np.unique(source, return_index=True)
    head[nodes] = at
    rank, pointers = np.append(label, 0), [np.append(head[target], arcs).astype(np.int32)]
    while (pointers[-1] != arcs).any():
        rank = np.unique(rank * (rank.max() + 1) + rank[pointers[-1]], return_inverse=True)[1]
        pointers.append(pointers[-1][pointers[-1]])

    begin = 4 * (first + np.arange(parts)) + entries
    lo, hi = np.searchsorted(source, begin), np.searchsorted(source, begin, "right")
    path = np.where(hi > lo, lo, arcs)
    for k in range(1, 4):  # the arc of least rank out of the entry
        other = np.minimum(lo + k, arcs)
        path = np.where((lo + k < hi) & (rank[other] < rank[path]), other, path)
    of, place = np.arange(parts), np.zeros(parts, np.int64)
    live = path != arcs
    of, place, path = of[live], place[live], path[live]
    for k, pointer in enumerate(pointers):
        further = pointer[path]
        live = further != arcs
        of, place, path = np.append(of, of[live]), np.append(place, place[live] + (1 << k)), np.append(path, further[live])
    order = np.lexsort((place, of))
    of, path = of[order], path[order]
    exits = entries.copy()
    ends = np.flatnonzero(np.append(of[1:] != of[:-1], True)) if len(of) else np.empty(0, int)
    exits[of[ends]] = target[path[ends]] % 4
    return of, LETTERS[label[path] - 1], exits, cost[begin]


# Spark


def _faults(placed: DataFrame) -> DataFrame:
    """conv_id, turn, _part, _at, initial and fault of each row, without its text."""
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    starts = F.col("role").startswith
    rows = placed.select(
        "conv_id", "turn", PART, AT, "_same",
        F.when(starts("s"), 0).when(starts("u"), 1).when(starts("a"), 2).otherwise(3).alias("initial"),
        F.when(bare == "", BLANK).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(FINE).alias("f"),
    )
    firsts = rows.where(F.col("f") != BLANK).groupBy("conv_id", "_same").agg(F.min(F.struct(PART, AT)).alias("x")).select("x.*", F.lit(True).alias("_first"))
    again = (F.col("f") != BLANK) & F.col("_first").isNull()
    return rows.join(firsts, [PART, AT], "left").select("conv_id", "turn", PART, AT, "initial", F.when(again, DUPLICATE).otherwise(F.col("f")).alias("fault"))


def _changes(col: pa.Array) -> np.ndarray:
    """True where a value differs from the one before; nulls are equal."""
    a, b = col[1:], col[:-1]
    differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
    return np.concatenate([np.ones(min(1, len(col)), bool), differ.to_numpy(zero_copy_only=False)])


def _sorted(t: pa.Table) -> pa.Table:
    return t.sort_by([(PART, "ascending"), (AT, "ascending")]).combine_chunks()


def _column(t: pa.Table, name: str) -> np.ndarray:
    return t[name].to_numpy().astype(np.int64)


def _edge_matrices(t: pa.Table) -> pa.Table:
    """The first and the last conversation of a partition, with the product of all their matrices in it."""
    t = _sorted(t)
    ids = t["conv_id"].combine_chunks()
    part = np.cumsum(_changes(ids)) - 1
    first = np.searchsorted(part, [0, part[-1]][: 1 + (part[-1] > 0)])
    matrices = []
    for at, number in zip(first, part[first], strict=True):
        rows = slice(at, np.searchsorted(part, number, "right"))
        matrices.append(to_end(_column(t, "initial")[rows], _column(t, "fault")[rows], part[rows])[0].ravel().tolist())
    return pa.table({"conv_id": ids.take(pa.array(first)), PART: t[PART].take(pa.array(first)), "matrix": pa.array(matrices, pa.list_(pa.int64()))})


def _tails(t: pa.Table) -> pa.Table:
    """For each part of one conversation the cost at its end; final for the last."""
    t = t.sort_by(PART)
    matrices = [np.array(m).reshape(1, 4, 4) for m in t["matrix"].to_pylist()]
    tails = [END]
    for m in matrices[:0:-1]:
        tails.append(_apply(m, tails[-1][None])[0])
    out = t.select(["conv_id", PART])
    return out.append_column("tail", pa.array([x.tolist() for x in tails[::-1]], pa.list_(pa.int64()))).append_column("final", pa.array([False] * (len(matrices) - 1) + [True]))


def _solve(t: pa.Table, entry: int | None = None) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, tuple]:
    """conv_ids, first rows and numbers of the parts in a partition, their entries, and their least paths."""
    ids = t["conv_id"].combine_chunks()
    part = np.cumsum(_changes(ids)) - 1
    first = np.flatnonzero(_changes(ids))
    at = pa.array(first)
    tails = np.array([END if x is None else x for x in t["tail"].take(at).to_pylist()], np.int64).reshape(-1, 4)
    final = np.array([x is not False for x in t["final"].take(at).to_pylist()])
    entries = np.full(len(first), entry) if entry is not None else np.array([x or 0 for x in t["entry"].take(at).to_pylist()], np.int64)
    return ids.take(at), first, part, entries, least_paths(_column(t, "initial"), _column(t, "fault"), part, tails, final, entries)


def _exits(t: pa.Table) -> pa.Table:
    """The states after each part, for the four states before it."""
    t = _sorted(t)
    found = [_solve(t, q) for q in range(4)]
    exits = np.stack([x[4][2] for x in found], 1).tolist()
    return pa.table({"conv_id": found[0][0], PART: t[PART].take(pa.array(found[0][1])), "exits": pa.array(exits, pa.list_(pa.int64()))})


def _entries(t: pa.Table) -> pa.Table:
    """The state before each part of one conversation."""
    t = t.sort_by(PART)
    states = [START]
    for exits in t["exits"].to_pylist()[:-1]:
        states.append(exits[states[-1]])
    return t.select(["conv_id", PART, "tail", "final"]).append_column("entry", pa.array(states, pa.int64()))


STATS = ["blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn", "first_initial", "last_initial", "cost", "entry"]


def _headers(t: pa.Table) -> pa.Table:
    """One row a part: its audit and its figures, in the order of STATS."""
    t = _sorted(t)
    ids, first, part, entries, (of, letters, _, cost) = _solve(t)
    initial, fault = _column(t, "initial"), _column(t, "fault")
    last, parts = np.append(first[1:], len(part)) - 1, len(first)
    inside = part[1:] == part[:-1] if len(part) else np.empty(0, bool)
    count = lambda mask: np.bincount(part[mask], minlength=parts)
    turn = t["turn"].combine_chunks()
    known = pc.is_valid(turn).to_numpy(zero_copy_only=False)
    number = pc.fill_null(turn.cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
    new = known & np.append(True, ~inside | ~known[:-1] | (number[1:] != number[:-1]))[: len(part)]
    n_known = count(known)
    lowest, highest = number[np.minimum(last - n_known + 1, last)], number[last]  # nulls come first
    turns = [[(int(a) if k else None), (int(b) if k else None)] for a, b, k in zip(lowest, highest, n_known, strict=True)]
    illegal = count(np.append(False, inside & ~LEGAL[initial[:-1], initial[1:]])[: len(part)])
    rows = zip(count(fault == BLANK), count(fault == DUPLICATE), count(fault == TRUNCATED), illegal, count(new), turns, initial[first], initial[last], cost, entries, strict=True)
    stats = [[int(b), int(d), int(r), int(i), int(n), *t2, int(x), int(y), int(c), int(e)] for b, d, r, i, n, t2, x, y, c, e in rows]
    ends = np.searchsorted(of, np.arange(parts + 1))
    text = letters.tobytes().decode()
    return pa.table({"conv_id": ids, PART: t[PART].take(pa.array(first)), "audit": [text[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], "stats": pa.array(stats, pa.list_(pa.int64()))})


def plan(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows in order, headers): the rows of df with their places, and for each part of a conversation its audit and figures."""
    key = df.schema["conv_id"].dataType.simpleString()
    own = df.select("conv_id", F.col("turn").cast("bigint").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    own = own.withColumn("_same", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))))
    placed = in_order(own.withColumn("_tie", F.monotonically_increasing_id()), "conv_id", "turn", "_same", "_tie")
    rows = materialize(_faults(placed), "faults")
    edges = rows.groupBy(PART).applyInArrow(_edge_matrices, f"conv_id {key}, {PART} int, matrix array<bigint>")
    edges = materialize(edges, "edges")
    cut = edges.groupBy("conv_id").count().where("count > 1")
    edges = edges.alias("e").join(F.broadcast(cut).alias("c"), same(["conv_id"], "e", "c"), "left_semi")  # at most two a partition
    edges = materialize(edges.groupBy("conv_id").applyInArrow(_tails, f"conv_id {key}, {PART} int, tail array<bigint>, final boolean"), "tails")

    def with_edges(table: DataFrame, how: str) -> DataFrame:
        more = [c for c in table.columns if c not in ("conv_id", PART)]
        joined = rows.alias("r").join(F.broadcast(table).alias("t"), same([PART, "conv_id"], "r", "t"), how)
        return joined.select("r.*", *(f"t.{c}" for c in more))

    exits = with_edges(edges, "inner").groupBy(PART).applyInArrow(_exits, f"conv_id {key}, {PART} int, exits array<bigint>")
    known = edges.alias("a").join(F.broadcast(exits).alias("b"), same([PART, "conv_id"], "a", "b")).select("a.*", "b.exits")
    entries = materialize(known.groupBy("conv_id").applyInArrow(_entries, f"conv_id {key}, {PART} int, tail array<bigint>, final boolean, entry bigint"), "entries")
    headers = with_edges(entries, "left").groupBy(PART).applyInArrow(_headers, f"conv_id {key}, {PART} int, audit string, stats array<bigint>")
    return placed, headers


def _stream(placed: DataFrame, headers: DataFrame, ids: DataFrame) -> DataFrame:
    """Conversations one after another: their ids (kind 0), then for each part its header (1) and its rows (2) in order."""
    each = ids.select("conv_id", F.lit(-1).alias(PART), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias(AT), *(F.lit(None).cast(t).alias(c) for c, t in (("role", "string"), ("text", "string"), ("audit", "string"), ("stats", "array<bigint>"))))
    heads = headers.select("conv_id", PART, F.lit(1).alias("kind"), F.lit(0).cast("bigint").alias(AT), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "audit", "stats")
    rows = placed.select("conv_id", PART, F.lit(2).alias("kind"), AT, "role", "text", F.lit(None).cast("string").alias("audit"), F.lit(None).cast("array<bigint>").alias("stats"))
    return each.union(heads).union(rows).repartition("conv_id").sortWithinPartitions("conv_id", PART, "kind", AT)


class _Conversation:
    """Replays the audits of one conversation as its rows come."""

    def __init__(self, key) -> None:
        self.key, self.audits, self.stats, self.emitted = key, [], [], 0
        self.state, self.audit, self.at, self.last = START, "", 0, -1

    def _made(self) -> tuple[str, str, str]:
        self.state = int(NEXT[self.state])
        return ROLE[self.state], "", self.audit[self.at]

    def _inserts(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            yield self._made()
            self.at += 1

    def take(self, kind: int, role: str, text: str, audit: str, stats: list) -> Iterator[tuple[str, str, str]]:
        """The repaired turns (role, text, edit) up to and with a row."""
        if kind == 1:
            self.audits.append(audit), self.stats.append(stats)
            self.audit, self.at, self.state = audit, 0, stats[STATS.index("entry")]
            self.last = len(audit.rstrip("I")) - 1  # only inserts follow it
        elif kind == 2:
            yield from self._inserts()
            edit = self.audit[self.at]
            if edit == "R":
                role, _, _ = self._made()
                yield role, text, edit
            elif edit == "K":
                self.state = int(KEPT["sua".index(role[0]), self.state])
                yield role, text, edit
            self.at += 1
            if self.at > self.last:
                yield from self._inserts()

    def figures(self) -> dict:
        total = lambda name: sum(s[STATS.index(name)] for s in self.stats)
        get = lambda s, name: s[STATS.index(name)]
        pairs = list(zip(self.stats[:-1], self.stats[1:], strict=True))
        illegal = total("illegal") + sum(not LEGAL[get(a, "last_initial"), get(b, "first_initial")] for a, b in pairs)
        known = [s for s in self.stats if get(s, "first_turn") is not None]
        gaps = 0
        if known:
            turns = total("turns") - sum(get(a, "last_turn") == get(b, "first_turn") for a, b in zip(known[:-1], known[1:], strict=True))
            gaps = get(known[-1], "last_turn") - get(known[0], "first_turn") + 1 - turns
        cost = get(self.stats[0], "cost") if self.stats else 0
        return {"gaps": gaps, "blank": total("blank"), "duplicate": total("duplicate"), "truncated": total("truncated"), "illegal": illegal, "cost": cost, "audit": "".join(self.audits)}


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Conversation, tuple | None]]:
    """(conversation, turn) for each repaired turn, and (conversation, None) at its end."""
    now = None
    for batch in batches:
        for key, kind, role, text, audit, stats in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text", "audit", "stats")), strict=True):
            if now is None or key != now.key:
                if now is not None:
                    yield now, None
                now = _Conversation(key)
            for turn in now.take(kind, role, text, audit, stats):
                yield now, turn
    if now is not None:
        yield now, None


def _digests(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sha = [], hashlib.sha256()
        for conversation, turn in _conversations(batches):
            if turn is None:
                rows.append({"conv_id": conversation.key, **conversation.figures(), "repaired_sha256": sha.hexdigest()})
                sha = hashlib.sha256()
            else:
                sha.update((("\n" if conversation.emitted else "") + turn[0] + ":" + turn[1]).encode())
                conversation.emitted += 1
            if len(rows) >= 2000:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def _turns(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for conversation, turn in _conversations(batches):
            if turn is not None:
                rows.append({"conv_id": conversation.key, "turn": conversation.emitted, "role": turn[0], "text": turn[1], "edit": turn[2]})
                conversation.emitted += 1
                size += len(turn[1])
            if len(rows) >= 2000 or size > 1 << 24:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def _run(df: DataFrame, ids: DataFrame, make, fields: list[tuple[str, str]]) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = StructType([df.schema["conv_id"]])
    for name, kind in fields:
        kinds = kinds.add(name, kind)
    return _stream(*plan(df), ids.select("conv_id").distinct()).mapInArrow(make(to_arrow_schema(kinds)), kinds)


def repaired_turns(df: DataFrame) -> DataFrame:
    """conv_id, turn (from 0), role, text and edit (K, R or I) of the repaired conversations."""
    return _run(df, df, _turns, [("turn", "long"), ("role", "string"), ("text", "string"), ("edit", "string")])


def repair(df: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row a conv_id of df (or of ids, which may have more): gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256, the SHA-256 of the repaired `role:text`, joined by newlines."""
    counts = [(c, "long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return _run(df, df if ids is None else ids, _digests, [*counts, ("audit", "string"), ("repaired_sha256", "string")])


#: The costs to go and least audits of the four states, from the last row to the first; the repaired roles after it by counting.
ORACLE = f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations
), hit AS (SELECT *, {crc_sql("k")} % 20 AS d FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN d = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hit WHERE d <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(CAST(length(role) AS VARCHAR) || ':' || role || text), copy) AS i,
    count(*) OVER (PARTITION BY conv_id) AS n, substr(role, 1, 1) AS r, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM damaged
), judged AS (
  SELECT *, CASE WHEN bare = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
    lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r AS pair
  FROM placed
), solved AS (
  SELECT DISTINCT conv_id, n + 1 AS i, [{{'c': 0::BIGINT, 'a': ''}}, {{'c': 4::BIGINT, 'a': 'II'}}, {{'c': 2::BIGINT, 'a': 'I'}}, {{'c': 0::BIGINT, 'a': ''}}] AS v FROM placed
  UNION ALL
  SELECT conv_id, i, list_transform([1, 2, 3, 4], lambda q: list_sort([
    w[q], {{'c': 2 + w[[3, 3, 4, 3][q]].c, 'a': 'I' || w[[3, 3, 4, 3][q]].a}}, {{'c': 4 + w[[4, 4, 3, 4][q]].c, 'a': 'II' || w[[4, 4, 3, 4][q]].a}}])[1])
  FROM (
    SELECT s.conv_id, j.i, list_transform([1, 2, 3, 4], lambda q: list_sort([
      {{'c': 3 + s.v[q].c, 'a': 'D' || s.v[q].a}},
      {{'c': CASE WHEN j.fault IN ('b', 'd') THEN 1000000000 ELSE 2 + CAST(j.fault = 't' AS BIGINT) END + s.v[[3, 3, 4, 3][q]].c, 'a': 'R' || s.v[[3, 3, 4, 3][q]].a}},
      {{'c': CASE WHEN j.fault IN ('b', 'd') OR CASE j.r WHEN 's' THEN q <> 1 WHEN 'u' THEN q = 3 WHEN 'a' THEN q <> 3 ELSE true END THEN 1000000000 ELSE CAST(j.fault = 't' AS BIGINT) END
        + s.v[CASE j.r WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].c, 'a': 'K' || s.v[CASE j.r WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].a}}])[1]) AS w
    FROM solved s JOIN judged j ON j.conv_id IS NOT DISTINCT FROM s.conv_id AND j.i = s.i - 1
  )
), best AS (SELECT conv_id, v[1].c AS cost, v[1].a AS audit FROM solved WHERE i = 1),
edits AS (
  SELECT conv_id, p, e, sum(CASE WHEN e <> 'I' THEN 1 ELSE 0 END) OVER w AS i, sum(CASE WHEN e <> 'D' THEN 1 ELSE 0 END) OVER w AS m
  FROM (SELECT conv_id, unnest(range(1, length(audit) + 1)) AS p, substr(audit, p, 1) AS e FROM best)
  WINDOW w AS (PARTITION BY conv_id ORDER BY p)
), made AS (
  SELECT e.conv_id, e.p, e.e, e.m - max(CASE WHEN e.e = 'K' AND j.r = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS m, j.role, j.text
  FROM edits e LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM e.conv_id AND j.i = e.i AND e.e <> 'I'
), repaired AS (
  SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN m % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS whole
  FROM made WHERE e <> 'D' GROUP BY conv_id
), figures AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id
)
SELECT o.conv_id, CAST(coalesce(f.gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(f.blank, 0) AS BIGINT) AS blank, CAST(coalesce(f.duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(f.truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(f.illegal, 0) AS BIGINT) AS illegal, coalesce(b.cost, 0) AS cost, coalesce(b.audit, '') AS audit,
  sha256(coalesce(r.whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id
"""
