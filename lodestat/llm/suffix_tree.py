"""LM scoring (operator 8): a probabilistic suffix tree over the bytes of the text, and a unigram base score.

A text is its words joined by single blanks, A-Z lower-cased, with an end symbol. Counts of all byte runs of DEPTH + 1 come from every
training text. A context stays in the tree if the divergence of its next-symbol distribution from its parent's (its longest proper suffix), times its count, reaches KEEP nats,
and if its parent stays. Distributions are smoothed towards the parent's (Witten-Bell) and, at the root, towards uniform. Each symbol
is predicted by the longest suffix of what precedes it that is in the tree. Every context that passes stays, so the tree grows with the
corpus. Counting and tests are Spark jobs over the whole corpus. The tree is built and broadcast in blocks of about TREE_ROWS rows, by the
last two bytes of the context: a symbol is scored in the pass of its block, so a larger tree costs passes and not memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.llm.common import ascii_lower, held_out, materialize, ragged, sliced, word_hashes, words

DEPTH, KEEP, FREQUENT, TREE_ROWS = 5, 12.0, 1 << 19, 3_000_000
#: Symbols that are counted, and scored, at a time, and rows of counts that a task holds before it adds them up.
_END, _PIECE, _SCORED, _HELD = b"\n", 1_000_000, 500_000, 2_000_000


class Table:
    """A hash table from uint64 to float32 with open addressing, built and searched for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.keys, self.values = np.full(1 << self.bits, np.uint64(2**64 - 1)), np.zeros(1 << self.bits, np.float32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[at] == np.uint64(2**64 - 1)
            self.keys[at[free]] = keys[left[free]]  # of several keys for a slot, one is written
            won = free & (self.keys[at] == keys[left])
            self.values[at[won]] = values[left[won]]
            left, at = left[~won], (at[~won] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value, found); the value is 0 where the key is missing."""
        at = self._slot(keys)
        got = self.keys[at]
        found = got == keys
        value = np.where(found, self.values[at], np.float32(0))
        open_ = np.flatnonzero(~found & (got != np.uint64(2**64 - 1)))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            got = self.keys[at[open_]]
            hit = got == keys[open_]
            found[open_[hit]], value[open_[hit]] = True, self.values[at[open_[hit]]]
            open_ = open_[~hit & (got != np.uint64(2**64 - 1))]
        return value, found


def _normal(text: str) -> bytes:
    return b" ".join(text.encode("utf-8", "replace").lower().split()) + _END


def _codes(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol, it (lowest byte) with the depth symbols before it, and the number of its text. Texts begin after end symbols."""
    b = np.frombuffer(b"".join(_END * depth + t for t in texts), np.uint8)
    code = np.zeros(max(0, len(b) - depth), np.uint64)
    for j in range(depth + 1):
        code |= b[j : len(b) - depth + j].astype(np.uint64) << np.uint64(8 * (depth - j))
    n = np.array([len(t) for t in texts], np.int64)
    doc = np.repeat(np.arange(len(texts)), n)
    return code[np.arange(len(doc)) + doc * depth], doc


def _pieces(texts: list[bytes], depth: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """_codes() of texts a few at a time; of very long texts part by part, with the context before each part."""
    at, size, first = [], 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            code, doc = _codes(at, depth)
            yield code, doc + first
            at, size, first = [], 0, i
        if len(t) > most:
            for s in range(0, len(t), most):
                code, _ = _codes([t[max(0, s - depth) : s + most]], depth)
                code = code[min(s, depth) :]
                yield code, np.full(len(code), i)
            first = i + 1
            continue
        at.append(t)
        size += len(t)
    if at:
        code, doc = _codes(at, depth)
        yield code, doc + first


def gram_table(docs: DataFrame, text: str, depth: int = DEPTH) -> DataFrame:
    """(g, n): how often each run of depth + 1 bytes occurs. A task adds up what it reads before anything is shuffled."""

    def merge(g: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(g, kind="stable")
        g, n = g[order], n[order]
        new = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        return g[new], np.add.reduceat(n, new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        add = lambda: merge(*(np.concatenate(x) for x in zip(*held)))
        out = lambda g, n: pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(n)], names=["g", "n"])
        for b in sliced(batches, "t", 4 * _PIECE):
            for code, _ in _pieces([_normal(t) for t in b.column("t").to_pylist()], depth, _PIECE):
                code.sort()
                new = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
                held.append((code[new], np.diff(np.append(new, len(code)))))
                rows += len(new)
                if rows > _HELD:
                    held = [add()]
                    rows = len(held[0][0])
                    if rows > _HELD // 2:
                        yield out(*held[0])
                        held, rows = [], 0
        if held:
            yield out(*add())

    return docs.select(F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))


def tree_counts(grams: DataFrame, depth: int = DEPTH, keep: float = KEEP) -> DataFrame:
    """(d, code, n): next-symbol counts of the contexts that pass the divergence test; code is the context of d bytes and the symbol."""
    low = lambda c, b: F.expr(f"{c} & (shiftleft(1L, 8 * ({b})) - 1)")
    level = grams.select(F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("d"), "g", "n").withColumn("code", low("g", "d + 1"))
    count = level.groupBy("d", "code").agg(F.sum("n").alias("n")).withColumn("ctx", F.shiftright("code", 8))
    count = materialize(count, "counts")
    total = count.groupBy("d", "ctx").agg(F.sum("n").alias("total"))
    share = count.join(total, ["d", "ctx"])
    parent = share.select((F.col("d") + 1).alias("d"), F.col("code").alias("tail"), (F.col("n") / F.col("total")).alias("p"))
    both = share.where("d > 0").withColumn("tail", low("code", "d")).join(parent, ["d", "tail"])
    gain = both.groupBy("d", "ctx").agg(F.sum(F.col("n") * (F.log(F.col("n") / F.col("total")) - F.log("p"))).alias("gain"))
    kept = gain.where(F.col("gain") >= keep).select("d", "ctx")
    return count.join(kept.union(grams.sparkSession.sql("select 0 d, 0L ctx")), ["d", "ctx"], "left_semi").select("d", "code", "n")


def build(counts: DataFrame, depth: int = DEPTH) -> Table:
    """The tree as one table: key (d, context, symbol) to log10 p, key (16 + d, context) to log10 of the weight of the parent."""
    got = counts.toArrow()
    d, code, n = (got.column(c).to_numpy() for c in ("d", "code", "n"))
    keys, values, below, kept = [], [], None, None
    for k in range(depth + 1):
        on = np.flatnonzero(d == k)
        on = on[np.argsort(code[on], kind="stable")]
        c, m = code[on].astype(np.uint64), n[on].astype(float)
        ctx = c >> np.uint64(8)
        if k:
            stays = np.isin(ctx & np.uint64((1 << 8 * (k - 1)) - 1), kept)
            c, m, ctx = c[stays], m[stays], ctx[stays]
            prior = below[1][np.searchsorted(below[0], c & np.uint64((1 << 8 * k) - 1))] if len(c) else np.zeros(0)
        else:
            prior = np.full(len(c), 1 / 256)
        if not len(c):
            break
        new = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]]))
        kinds = np.diff(np.append(new, len(ctx)))
        size = np.add.reduceat(m, new) + kinds
        p = (m + np.repeat(kinds, kinds) * prior) / np.repeat(size, kinds)
        keys += [c | np.uint64(k << 56), ctx[new] | np.uint64(16 + k << 56)]
        values += [np.log10(p), np.log10(kinds / size)]
        below, kept = (c, p), ctx[new]
    return Table(np.concatenate(keys) if keys else np.zeros(0, np.uint64), np.concatenate(values) if values else np.zeros(0))


def blocks(counts: DataFrame, rows: int = TREE_ROWS) -> list[tuple[int, int]]:
    """Ranges (first, last) of the last two bytes of contexts, each with about so many rows of tree_counts(). At most 2**16 numbers reach the driver."""
    pair = F.expr("shiftright(code, 8) & 65535L")
    out, first, held = [], 0, 0
    for r in counts.where("d > 1").groupBy(pair.alias("b")).count().orderBy("b").collect():
        if held and held + r["count"] > rows:
            out.append((first, r.b - 1))
            first, held = r.b, 0
        held += r["count"]
    return [*out, (first, 0xFFFF)]


def symbol_scores(code: np.ndarray, tree: Table, depth: int = DEPTH) -> np.ndarray:
    """log10 p of each symbol."""
    out, left = np.zeros(len(code)), np.arange(len(code))
    for k in range(depth, -1, -1):
        c = code[left] & np.uint64((1 << 8 * (k + 1)) - 1)
        value, found = tree.get(c | np.uint64(k << 56))
        out[left] += value
        left, c = left[~found], c[~found]
        if not len(left):
            return out
        out[left] += tree.get(c >> np.uint64(8) | np.uint64(16 + k << 56))[0]
    out[left] -= np.log10(256)
    return out


def token_counts(docs: DataFrame, text: str) -> DataFrame:
    """(h, n): counts of words by hash, without the end token."""
    return docs.select(F.explode(word_hashes(words(ascii_lower(F.col(text))))).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))


def score(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", depth: int = DEPTH, keep: float = KEEP, frequent: int = FREQUENT, tree_rows: int = TREE_ROWS) -> DataFrame:
    """docs' key with n_tokens, n_known, train_tokens, base_score and score (log10 probability of the whole text under the tree).

    train says which rows to learn from. Null and empty texts are the end token alone. Repeated rows count each and get equal rows.
    Null keys are kept. With an empty table, or nothing to learn from, scores are those of uniform models. Other columns are not read.
    """
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    sc = spark.sparkContext
    learn = docs.where(train)
    tokens = materialize(token_counts(learn, text), "tokens")
    ends = learn.count()
    n_words, kinds = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    n_all, n_kinds = n_words + ends, kinds + (ends > 0)
    # the most frequent words are looked up in place: as many whole classes of log2(count) as `frequent` rows hold; the others are joined
    least, held = 2.0**60, 0
    for r in tokens.groupBy(F.floor(4 * F.log2("n")).alias("b")).count().orderBy(F.desc("b")).collect():
        held += r["count"]
        if held > frequent:
            break
        least = 2.0 ** (r["b"] / 4)
    rule = F.floor(4 * F.log2("n")) >= F.lit(round(4 * np.log2(least)))
    often = tokens.where(rule).toArrow()
    logs = lambda c: np.log10((c + 1) / (n_all + n_kinds + 1))
    sent_words = sc.broadcast(Table(often.column("h").to_numpy().view(np.uint64), often.column("n").to_numpy().astype(float)))
    counts = materialize(tree_counts(materialize(gram_table(learn, text, depth), "grams"), depth, keep), "tree")
    ranges = blocks(counts, tree_rows) if depth > 1 else [(0, 0xFFFF)]
    pair = F.expr("shiftright(code, 8) & 65535L")
    tree = lambda first, last: sc.broadcast(build(counts.where((F.col("d") < 2) | pair.between(first, last)), depth))
    sent_tree, end_log = tree(*ranges[0]), float(logs(ends))

    def totals(texts: list[bytes], table: Table, first: int, last: int) -> np.ndarray:
        total = np.zeros(len(texts))
        for code, at in _pieces(texts, depth, _SCORED):
            if len(ranges) > 1:
                own = code >> np.uint64(8) & np.uint64(0xFFFF)
                on = (own >= first) & (own <= last)
                code, at = code[on], at[on]
            total += np.bincount(at, symbol_scores(code, table, depth), len(texts))
        return total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, tree_, uid = sent_words.value, sent_tree.value, TaskContext.get().partitionId() << 36
        for b in sliced(batches, "t", _SCORED):
            h, offsets = ragged(b.column("h"))
            n, texts = np.diff(offsets), [_normal(t) for t in b.column("t").to_pylist()]
            doc = np.repeat(np.arange(len(n)), n)
            count, found = vocabulary.get(h)
            base = np.bincount(doc[found], logs(count[found].astype(float)), len(n)) + end_log
            known = np.bincount(doc[found], minlength=len(n)) + (ends > 0)
            total = totals(texts, tree_, *ranges[0])
            rare = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc[~found], minlength=len(n)))]), pa.int32()), pa.array(h[~found].view(np.int64)))
            cols = [b.column("k"), b.column("x"), pa.array(uid + np.arange(len(n))), pa.array(n + 1), pa.array(base), pa.array(known), pa.array(total), rare]
            yield pa.RecordBatch.from_arrays(cols, names=["k", "x", "uid", "n_tokens", "base", "known", "score", "rare"])
            uid += len(n)

    named = F.coalesce(F.col(text), F.lit(""))
    wide = docs.select(F.col(key).alias("k"), F.xxhash64(named).alias("x"), named.alias("t"), word_hashes(words(ascii_lower(F.col(text)))).alias("h"))
    part = materialize(wide.mapInArrow(run, f"k {kind}, x long, uid long, n_tokens long, base double, known long, score double, rare array<long>"), "scores")
    for first, last in ranges[1:]:  # the same rows once more, for the symbols of the next block
        sent = tree(first, last)

        def more(batches: Iterator[pa.RecordBatch], sent=sent, first=first, last=last) -> Iterator[pa.RecordBatch]:
            for b in sliced(batches, "t", _SCORED):
                total = totals([_normal(t) for t in b.column("t").to_pylist()], sent.value, first, last)
                yield pa.RecordBatch.from_arrays([b.column("k"), b.column("x"), pa.array(total)], names=["k2", "x2", "s"])

        block = wide.select("k", "x", "t").mapInArrow(more, f"k2 {kind}, x2 long, s double").groupBy("k2", "x2").agg(F.max("s").alias("s"))
        both = part.join(materialize(block, "block"), F.col("k").eqNullSafe(F.col("k2")) & (F.col("x") == F.col("x2")))
        part = materialize(both.withColumn("score", F.col("score") + F.col("s")).select(*part.columns), "scores")
        sent.unpersist()
    each = part.select("uid", F.explode("rare").alias("h")).groupBy("uid", "h").agg(F.count(F.lit(1)).alias("m"))
    worth = F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(n_all + n_kinds + 1)))
    rest = each.join(tokens.where(~rule), "h", "left").groupBy("uid").agg(F.sum(F.col("m") * worth).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("m")).otherwise(0)).alias("more_known"))
    out = part.drop("rare", "x").join(rest, "uid", "left")
    return out.select(F.col("k").alias(key), "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score")


def score_held_out(docs: DataFrame, key: str = "doc_id", text: str = "text", modulus: int = 7, **more) -> DataFrame:
    """score() that learns from rows whose crc32(key) mod modulus is not 2, with held_out."""
    out = held_out(F.col(key), modulus)
    return score(docs, ~out, key, text, **more).withColumn("held_out", out)
