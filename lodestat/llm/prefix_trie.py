"""Prefix trie of conversations: a node for each distinct sequence of first turns, with members, leaves and the tokens that sharing saves.

Method. Each turn has an MD5 of role and text. A prefix has two 64-bit digests, the xor of the hashes of its (depth, turn), so that they are
running values over range partitions and a parent's digest is known from its child's. Distinct digests are the nodes; a digest under which
depth, turn and parent are not the same in all rows is an error. Nodes that at least two conversations share are dealt to shards. A shard
builds a minimal perfect hash of its digests (levels of bits; a key that is alone in its bit takes the number of that bit), checks each slot
against the digest that is stored there, scatters its counts into flat arrays at these slots, and adds them to their parents through an
array of parent slots, the deepest first.

Scale. Nodes of more than `heavy` conversations, which are fewer than turns / heavy, form the top of the trie, a shard of its own; below it,
a subtree has at most `heavy` conversations and lies in one shard, with others. heavy grows with the table so that the top has at most
500,000 nodes. A node that one conversation alone reaches has one leaf, saves nothing and needs no slot. The top is all that is
broadcast. Conversation ids that end at a node are joined to pieces by range partition and hashed as a stream.

A null role or text counts as empty. Turns of a conversation are in the order of turn (null first), then of the MD5 of role and text. Rows
with a null conv_id belong to no conversation and are left out. No conversation gives no node. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.llm.common import crc_sql, materialize, mix
from lodestat.operators.ranges import PART, accumulate, in_order, numbered

#: Nodes of the top, which one task holds and which are broadcast.
TOP_NODES = 500_000
#: Shared nodes that a shard has on average.
SHARD_NODES = 8192
LEAST_HEAVY = 1000
EMPTY = hashlib.sha256(b"").hexdigest()
DIGEST = ["p1", "p2"]


# turns


def turns(df: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), same (the MD5 of role and text) and bytes (of the text) of each turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    own = df.where("conv_id is not null").select(
        "conv_id", "turn", F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("same"), F.octet_length(text).cast("bigint").alias("bytes")
    )
    return numbered(own, ["conv_id"], ["turn", "same"], "pos").select("conv_id", "pos", "same", "bytes")


def rebuild(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, ids) of rebuilt conversations: that of c has the first h turns of conversation c - c % 5, then its own after its first h;
    h = crc32(c) % 9. Columns conv_id, depth, same, bytes and last; ids has every conv_id and its number of turns."""
    own = materialize(own, "turns")
    sizes = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    each = sizes.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % 5).alias("source"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).alias("h"))
    found = sizes.select(F.col("conv_id").alias("source"), F.col("n").alias("m"))
    k = F.least("h", F.coalesce("m", F.lit(0)))
    each = each.join(found, "source", "left").select("conv_id", "source", "h", k.alias("k"), (k + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    each = materialize(each, "conversations")
    heads = own.where("pos <= 8").withColumnRenamed("conv_id", "source").join(each, "source").where("pos <= h").withColumn("depth", F.col("pos"))  # at most five of a source
    tails = own.join(each, "conv_id").where("pos > h").withColumn("depth", F.col("k") + F.col("pos") - F.col("h"))
    columns = ["conv_id", "depth", "same", "bytes", (F.col("depth") == F.col("length")).alias("last")]
    return heads.select(*columns).union(tails.select(*columns)), each.select("conv_id", "length")


# a shard


class SlotTable:
    """A minimal perfect hash of distinct 128-bit keys, and the keys at their slots."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        left, taken = np.arange(len(hi)), 0
        while len(left):
            at = self._bit(hi[left], lo[left], len(self.levels), 2 * len(left))
            alone = np.bincount(at, minlength=2 * len(left)) == 1
            self.levels.append((alone, taken + np.cumsum(alone) - 1))
            taken += int(alone.sum())
            left = left[~alone[at]]
            if len(self.levels) > 200:
                raise ValueError("keys are not distinct")
        self.hi, self.lo = np.zeros(taken, np.uint64), np.zeros(taken, np.uint64)
        slots = self._find(hi, lo)
        self.hi[slots], self.lo[slots] = hi, lo
        if (self.slots(hi, lo) < 0).any():
            raise ValueError("two keys share a slot")

    @staticmethod
    def _bit(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(hi ^ mix(lo + np.uint64(level) * np.uint64(0x9E3779B97F4A7C15))) % np.uint64(size)).astype(np.int64)

    def _find(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        out, left = np.full(len(hi), -1), np.arange(len(hi))
        for level, (alone, slot) in enumerate(self.levels):
            at = self._bit(hi[left], lo[left], level, len(alone))
            out[left] = np.where(alone[at], slot[at], -1)
            left = left[~alone[at]]
        return out

    def slots(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that are not in the table."""
        out = self._find(hi, lo)
        if len(self.hi):
            out[(self.hi[out] != hi) | (self.lo[out] != lo)] = -1
        return out


NODE = "p1 bigint, p2 bigint, q1 bigint, q2 bigint, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint"
SUMS = ["n_children", "n_leaves", "saved_tokens"]


def add_up(t: pa.Table) -> pa.Table:
    """Nodes with the sums over their subtrees. n_children, n_leaves and saved_tokens come with what lies outside the shard below a node;
    outside tells whether the parent does."""
    key = lambda c: t[c].to_numpy().astype(np.int64, copy=False).view(np.uint64)
    number = lambda c: t[c].to_numpy().astype(np.int64, copy=False)
    table = SlotTable(key("p1"), key("p2"))
    slot, parent = table.slots(key("p1"), key("p2")), table.slots(key("q1"), key("q2"))
    depth, n = number("depth"), number("n_convs")
    parent[depth == 0] = -1
    up, sums = np.full(len(slot), -1), {c: np.zeros(len(slot), np.int64) for c in SUMS}
    up[slot] = parent
    for c in SUMS:
        sums[c][slot] = number(c)
    sums["n_leaves"][slot] += number("n_ends") == n
    sums["saved_tokens"][slot] += (n - 1) * number("bytes")
    deepest = np.argsort(-depth, kind="stable")
    for level in np.split(slot[deepest], np.flatnonzero(np.diff(depth[deepest])) + 1):
        level = level[up[level] >= 0]
        np.add.at(sums["n_children"], up[level], 1)
        for c in SUMS[1:]:
            np.add.at(sums[c], up[level], sums[c][level])
    out = t.select([f.split()[0] for f in NODE.split(", ")])
    for c in SUMS:
        out = out.append_column(c, pa.array(sums[c][slot]))
    return out.append_column("outside", pa.array(parent < 0))


# the trie


def _paths(rows: DataFrame) -> DataFrame:
    """conv_id, depth, last, bytes, digest p1 p2, the parent's q1 q2, and a hash t of the turn."""
    h1, h2 = F.xxhash64("depth", "same"), F.xxhash64("same", "depth")
    path = accumulate(in_order(rows, "conv_id", "depth"), ["conv_id"], p1=("xor", h1), p2=("xor", h2))
    return path.select("conv_id", "depth", "last", "bytes", "p1", "p2", F.col("p1").bitwiseXOR(h1).alias("q1"), F.col("p2").bitwiseXOR(h2).alias("q2"), F.xxhash64(F.lit(1), "same").alias("t"))


def _nodes(path: DataFrame, ids: DataFrame) -> DataFrame:
    """One row a distinct digest, the root included."""
    one = ["depth", "q1", "q2", "t"]
    grouped = path.groupBy(*DIGEST).agg(
        *(F.min(c).alias(c) for c in one), *(F.max(c).alias(f"{c}_") for c in one),
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("bytes").alias("bytes"), F.count_if("last").alias("n_ends"),
    )
    agree = F.lit(True)
    for c in one:
        agree = agree & (F.col(c) == F.col(f"{c}_"))
    checked = F.when(agree, F.col("depth")).otherwise(F.raise_error(F.lit("two prefixes share a digest")).cast("bigint"))
    columns = [*DIGEST, "q1", "q2", "depth", "n_convs", "conv_id", "bytes", "n_ends"]
    root = ids.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.count_if(F.col("length") == 0).alias("n_ends")).where("n_convs > 0")
    root = root.select(*(F.lit(0).cast("bigint").alias(c) for c in (*DIGEST, "q1", "q2", "depth", "bytes")), "n_convs", "conv_id", "n_ends").select(*columns)
    return grouped.withColumn("depth", checked).select(*columns).union(root)


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, sha, rows = None, None, []
    for batch in batches:
        for p1, p2, piece in zip(*(batch.column(c).to_pylist() for c in (*DIGEST, "piece")), strict=True):
            if (p1, p2) != now:
                if now is not None:
                    rows.append((*now, sha.hexdigest()))
                now, sha = (p1, p2), hashlib.sha256(piece.encode())
            else:
                sha.update(("," + piece).encode())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string()))], [*DIGEST, "ends_sha256"])
        rows = []
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]]), pa.array([sha.hexdigest()])], [*DIGEST, "ends_sha256"])


def _ends(path: DataFrame, ids: DataFrame) -> DataFrame:
    """p1, p2 and ends_sha256, the hash of the ids of the conversations that end there."""
    zero = F.lit(0).cast("bigint")
    ends = path.where("last").select(*DIGEST, "conv_id").union(ids.where("length = 0").select(zero, zero, "conv_id"))
    placed = in_order(ends, *DIGEST, "conv_id")
    piece = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = placed.groupBy(*DIGEST, PART).agg(piece.alias("piece"))  # no more than a partition of ids each
    return pieces.repartition(*DIGEST).sortWithinPartitions(*DIGEST, PART).mapInArrow(_hash_pieces, "p1 bigint, p2 bigint, ends_sha256 string")


def prefix_trie(rows: DataFrame, ids: DataFrame, heavy: int | None = None) -> DataFrame:
    """The nodes of conversations given by their turns (conv_id, depth from 1, same, bytes, last) and by all their ids (conv_id, length):
    conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256."""
    path = materialize(_paths(rows), "paths")
    nodes = materialize(_nodes(path, ids), "nodes")
    heavy = heavy or max(LEAST_HEAVY, path.count() // TOP_NODES)
    is_top = (F.col("n_convs") > heavy) | (F.col("depth") == 0)
    shared = F.col("n_convs") > 1
    parent = lambda df: df.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    top = F.broadcast(parent(nodes.where(is_top)))  # at most TOP_NODES and the root
    below = nodes.where("depth > 0")
    linked = below.join(top, ["q1", "q2"]).withColumn("alone", F.lit(False))
    deep = below.join(top, ["q1", "q2"], "left_anti").join(parent(nodes.where(shared & ~is_top)), ["q1", "q2"], "left")
    deep = deep.withColumn("alone", F.col("parent_conv_id").isNull()).withColumn("parent_conv_id", F.coalesce("parent_conv_id", "conv_id"))
    root = nodes.where("depth = 0").withColumns({"parent_conv_id": F.lit(None).cast("bigint"), "alone": F.lit(False)})
    linked = materialize(linked.unionByName(deep).unionByName(root), "linked")

    single = linked.where(~shared & ~is_top)
    done = single.select(*DIGEST, "conv_id", "depth", "parent_conv_id", "n_convs", (1 - F.col("n_ends")).alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"), F.lit(0).cast("bigint").alias("saved_tokens"))
    kids = single.where("not alone").groupBy("q1", "q2").agg(F.count(F.lit(1)).alias("kids"))
    kids = kids.select(F.col("q1").alias("p1"), F.col("q2").alias("p2"), "kids")
    several = linked.where(shared | is_top).join(kids, DIGEST, "left").na.fill(0, ["kids"])
    several = several.select(*linked.columns, *(F.col("kids").alias(c) for c in SUMS[:2]), F.lit(0).cast("bigint").alias("saved_tokens"))

    first_light = path.join(top.select(F.col("q1").alias("p1"), F.col("q2").alias("p2")), DIGEST, "left_anti").groupBy("conv_id").agg(F.min_by(F.struct(*DIGEST), "depth").alias("_root"))
    light = several.where(shared & ~is_top)
    shards = 1 + nodes.where(shared & ~is_top).count() // SHARD_NODES
    light = light.join(first_light, "conv_id").withColumn("_shard", F.pmod(F.xxhash64("_root"), F.lit(shards))).drop("_root")
    schema = f"{NODE}, n_children bigint, n_leaves bigint, saved_tokens bigint, outside boolean"
    light = materialize(light.groupBy("_shard").applyInArrow(lambda t: add_up(t), schema), "shards")

    into = light.where("outside").groupBy("q1", "q2").agg(F.count(F.lit(1)).alias("a"), F.sum("n_leaves").alias("b"), F.sum("saved_tokens").alias("c"))
    into = into.select(F.col("q1").alias("p1"), F.col("q2").alias("p2"), "a", "b", "c")
    head = several.where(is_top).join(into, DIGEST, "left").na.fill(0, ["a", "b", "c"])
    head = head.withColumns({c: F.col(c) + F.col(x) for c, x in zip(SUMS, "abc", strict=True)}).drop("a", "b", "c")
    head = head.groupBy(F.lit(0).alias("_shard")).applyInArrow(lambda t: add_up(t), schema)

    columns = [*DIGEST, "conv_id", "depth", "parent_conv_id", "n_convs", *SUMS]
    out = done.select(*columns).union(light.select(*columns)).union(head.select(*columns))
    out = out.join(_ends(path, ids), DIGEST, "left")
    return out.select(*columns[2:], F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


#: A prefix is the text of its turns' digests. A node's sums are those of the members that are the smallest of a node below it.
ORACLE = f"""
WITH own AS (
  SELECT conv_id, octet_length(encode(coalesce(text, ''))) AS bytes, md5(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS same,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, same) AS pos, count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS source, {crc_sql("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM own)
), rebuilt AS (
  SELECT c.conv_id, o.pos AS depth, o.same, o.bytes FROM convs c JOIN own o ON o.conv_id = c.source AND o.pos <= c.h
  UNION ALL
  SELECT c.conv_id, least(c.h, coalesce((SELECT max(n) FROM own s WHERE s.conv_id = c.source), 0)) + o.pos - c.h, o.same, o.bytes FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.pos > c.h
), paths AS (
  SELECT conv_id, depth, bytes, string_agg(same, '') OVER (PARTITION BY conv_id ORDER BY depth) AS prefix, depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM rebuilt
  UNION ALL
  SELECT c.conv_id, 0, 0, '', NOT EXISTS (SELECT 1 FROM rebuilt r WHERE r.conv_id = c.conv_id) FROM convs c
), nodes AS (
  SELECT prefix, depth, left(prefix, greatest(0, length(prefix) - 32)) AS parent, min(conv_id) AS conv_id, count(*) AS n, max(bytes) AS bytes, count(*) FILTER (last) AS ends,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '') AS ids
  FROM paths GROUP BY prefix, depth
), leaves AS (SELECT p.prefix, count(*) AS n FROM nodes u JOIN paths p ON p.conv_id = u.conv_id WHERE u.ends = u.n AND p.depth <= u.depth GROUP BY 1),
saved AS (SELECT p.prefix, sum((u.n - 1) * u.bytes) AS n FROM nodes u JOIN paths p ON p.conv_id = u.conv_id AND p.depth <= u.depth GROUP BY 1),
kids AS (SELECT parent, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1)
SELECT u.conv_id, CAST(u.depth AS BIGINT) AS depth, CASE WHEN u.depth > 0 THEN p.conv_id END AS parent_conv_id, u.n AS n_convs, coalesce(k.n, 0) AS n_children, l.n AS n_leaves,
  CAST(s.n AS BIGINT) AS saved_tokens, sha256(u.ids) AS ends_sha256
FROM nodes u JOIN nodes p ON p.prefix = u.parent LEFT JOIN kids k ON k.parent = u.prefix JOIN leaves l ON l.prefix = u.prefix JOIN saved s ON s.prefix = u.prefix
"""
