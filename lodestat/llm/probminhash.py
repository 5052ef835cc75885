"""MinHash near-dedup (operator 1): ProbMinHash signatures of weighted word shingles, banding, exact verification, components.

Texts with the same words collapse to one vertex first, named by the MD5 of its word hashes. Each shingle of weight w sends a
Poisson process of rate w to M registers; a register keeps its earliest arrival, and a process ends once its next arrival is later
than every register. Registers of two texts agree with their probability Jaccard similarity. Texts that agree on a band of ROWS
registers are candidates. A bucket of n texts never emits its n * n pairs: all are compared with one centre, the bucket's most popular
text. Where a bucket still holds several components, texts that cannot link to any other, because too many of their shingles are theirs alone,
leave; the rest are compared with a new centre, the text that lacks least of what the bucket shares, and at last across components, each
pair in one bucket, so no candidate link between components is lost. Links have multiset Jaccard similarity of SIMILARITY or more, measured exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestat.llm.common import fresh, materialize, mix, ragged, rolling, sliced, small, word_hashes, words

SHINGLE, SIMILARITY, M, ROWS = 5, 0.8, 96, 4
#: Texts that share a shingle at most for it to be rare.
RARE = 12
_STEP, _TWIST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def weighted_shingles(h: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, weight) of distinct shingles; a document of fewer words than a shingle is one shingle. Sorted by document."""
    n = np.diff(offsets)
    doc = np.repeat(np.arange(len(n)), n)
    g = rolling(h, shingle)
    at = np.arange(len(h)) - offsets[:-1][doc]
    keep = at < np.maximum(n[doc] - shingle + 1, 1)
    for i in np.flatnonzero((n > 0) & (n < shingle)):
        g[offsets[i]] = mix(rolling(h[offsets[i] : offsets[i + 1]], int(n[i]))[:1] + n[i].astype(np.uint64))[0]
    doc, g = doc[keep], g[keep]
    order = np.lexsort((g, doc))
    doc, g = doc[order], g[order]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (g[1:] != g[:-1])])) if len(g) else np.zeros(0, np.int64)
    return doc[new], g[new], np.diff(np.append(new, len(g)))


def signatures(doc: np.ndarray, g: np.ndarray, weight: np.ndarray, n_docs: int, m: int = M) -> np.ndarray:
    """n_docs x m winners. Rounds go over all shingles that can still win, so long texts cost about one arrival a shingle."""
    first, winner = np.full(n_docs * m, np.inf), np.zeros(n_docs * m, np.uint64)
    time, state, weight = np.zeros(len(g)), g.copy(), weight.astype(float)
    while len(g):
        with np.errstate(over="ignore"):
            state = state + _STEP
            r, k = mix(state), mix(state ^ _TWIST)
        time = time - np.log(((r >> np.uint64(11)).astype(float) + 0.5) / 2.0**53) / weight
        slot = doc * m + ((k >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(first, slot, time)
        won = first[slot] == time
        winner[slot[won]] = g[won]
        on = time < first.reshape(n_docs, m).max(axis=1)[doc]
        doc, g, weight, time, state = doc[on], g[on], weight[on], time[on], state[on]
    return winner.reshape(n_docs, m)


def bands(winner: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band; the band's number is mixed in."""
    n, m = winner.shape
    out = np.tile(np.arange(1, m // rows + 1, dtype=np.uint64) * _TWIST, (n, 1)) if n else np.zeros((0, m // rows), np.uint64)
    for j in range(rows):
        out = mix(out + winner[:, j::rows][:, : m // rows])
    return out


def _hashed(docs: DataFrame, text: str, *more: Column) -> DataFrame:
    return docs.select(*more, F.xxhash64(F.col(text)).alias("t"), word_hashes(words(F.col(text))).alias("h"))


def _vertices(h: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """MD5 of each document's word hashes, null without words."""
    raw = h.tobytes()
    return pa.array([hashlib.md5(raw[8 * a : 8 * e]).digest() if e > a else None for a, e in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())


def signed(docs: DataFrame, key: str, text: str, shingle: int, m: int, rows: int) -> DataFrame:
    """(k, t, v, n, keys) of each row: key, hash of the text, vertex (null without words), number of shingles, band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "h", 1_000_000):
            h, offsets = ragged(b.column("h"))
            doc, g, weight = weighted_shingles(h, offsets, shingle)
            keys = bands(signatures(doc, g, weight, b.num_rows, m), rows)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * keys.shape[1], pa.int32()), pa.array(keys.ravel().view(np.int64)))
            n = np.maximum(np.diff(offsets) - shingle + 1, 1)
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("t"), _vertices(h, offsets), pa.array(n), lists], names=["k", "t", "v", "n", "keys"])

    kind = docs.schema[key].dataType.simpleString()
    return _hashed(docs, text, F.col(key).alias("k")).mapInArrow(run, f"k {kind}, t long, v binary, n long, keys array<bigint>")


def shingle_sets(docs: DataFrame, texts: DataFrame, text: str, shingle: int) -> DataFrame:
    """(v, s) for the texts (v, t): a number for each shingle and repeat, so that the Jaccard similarity of the sets is that of the
    multisets. Other documents are dropped before their words are cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "h", 1_000_000):
            h, offsets = ragged(b.column("h"))
            doc, g, weight = weighted_shingles(h, offsets, shingle)
            nth = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
            with np.errstate(over="ignore"):
                s = np.repeat(g, weight) + nth.astype(np.uint64) * _STEP
            ends = np.concatenate([[0], np.cumsum(np.bincount(doc, weight, b.num_rows))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([_vertices(h, offsets), pa.ListArray.from_arrays(pa.array(ends), pa.array(s.view(np.int64)))], names=["v", "s"])

    need = small(materialize(texts.select("v", "t").distinct(), "need"))
    named = docs.select(F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("t"), F.xxhash64(F.lit(1), F.col(text)).alias("t2"))
    some = named.join(need.select("t").distinct(), "t", "left_semi").dropDuplicates(["t", "t2"])
    sets = _hashed(some, "text").mapInArrow(run, "v binary, s array<bigint>")
    return sets.join(need.select("v"), "v", "left_semi")


def verified(docs: DataFrame, pairs: DataFrame, text: str, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose exact similarity reaches the threshold. Only texts in pairs are read into the join."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("ta").alias("t")), F.struct(F.col("b").alias("v"), F.col("tb").alias("t")))).alias("x")).select("x.*")
    sets = materialize(shingle_sets(docs, ends, text, shingle), "sets")
    both = pairs.join(sets.select(F.col("v").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("v").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.withColumn("c", common).where(F.col("c") >= similarity * (F.size("sa") + F.size("sb") - F.col("c")) - 1e-9).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(v, root): the least vertex of each vertex's component, by alternating large-star and small-star until nothing changes."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("w")).distinct(), "edges")

    def signature(e: DataFrame) -> tuple:
        return tuple(e.select(F.count(F.lit(1)), F.sum(F.xxhash64("u", "w").cast("decimal(20,0)"))).first())

    def star(e: DataFrame, large: bool) -> DataFrame:
        seen = e.unionByName(e.select(F.col("w").alias("u"), F.col("u").alias("w"))) if large else e
        least = seen.groupBy("u").agg(F.min("w").alias("m")).withColumn("m", F.least("m", "u"))
        out = seen.join(least, "u")
        if large:
            return out.where("w > u").select(F.col("w").alias("u"), F.col("m").alias("w"))
        return out.where("w != m").select(F.col("w").alias("u"), F.col("m").alias("w")).union(least.select("u", "m"))

    before = signature(edges)
    while True:
        edges = materialize(star(star(edges, True).where("u != w").distinct(), False).where("u != w").distinct(), "edges")
        if (now := signature(edges)) == before:
            return edges.select(F.col("u").alias("v"), F.col("w").alias("root"))
        before = now


def _pair(df: DataFrame) -> DataFrame:
    """(a, b, ta, tb) of rows with v, t, v2, t2; a < b."""
    less = F.col("v") < F.col("v2")
    pick = lambda x, y: F.when(less, F.col(x)).otherwise(F.col(y))
    return df.select(pick("v", "v2").alias("a"), pick("v2", "v").alias("b"), pick("t", "t2").alias("ta"), pick("t2", "t").alias("tb")).distinct()


def _centred(t: DataFrame, similarity: float) -> DataFrame:
    """Pairs of each bucket's centre with its members of like size (and of other components, if t has them). Where c is known, the centre is the
    text with the largest share of common shingles, for it lacks least of what the others share. Else it is the most popular text: a text's
    popularity is the size of its buckets, and the original of many near copies is more popular than they are."""
    cols = [c for c in ("v", "t", "n", "c", "root") if c in t.columns]
    if "c" in cols:
        named, rank = t, F.col("c") / F.col("n")
    else:
        named, rank = t.join(t.groupBy("v").agg(F.sum("k").alias("fame")), "v"), F.col("fame")
    centre = named.groupBy("bucket").agg(F.max(F.struct(rank.alias("rank"), *cols)).alias("x")).select("bucket", *(F.col(f"x.{c}").alias(c + "2") for c in cols))
    pairs = t.join(centre, "bucket").where((F.col("v") != F.col("v2")) & (F.least("n", "n2") >= similarity * F.greatest("n", "n2") - 1e-9))
    return _pair(pairs.where("root != root2") if "root" in cols else pairs)


def _mixed(t: DataFrame, root: DataFrame) -> DataFrame:
    """Rows of the buckets that hold several components, with root."""
    named = t.drop("root").join(root, "v", "left").withColumn("root", F.coalesce("root", "v"))
    several = named.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("bucket")
    return named.join(several, "bucket", "left_semi")


def _able(t: DataFrame, docs: DataFrame, text: str, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Splits what may still link in t (with root) in two, by shingles that at most RARE texts of t have. Two texts share such a rare shingle, and
    are among the pairs returned, or all they share is common: then c, the number of a text's common shingles, bounds the overlap, and the
    rows returned are those whose c allows the similarity with a member of their bucket: c * (1 + s) >= s * (n + n2)."""
    sets = materialize(shingle_sets(docs, t, text, shingle), "sets")
    each = sets.select("v", F.explode("s").alias("s"))
    rare = materialize(each.join(each.groupBy("s").agg(F.count(F.lit(1)).alias("f")).where(F.col("f") <= RARE), "s"), "rare")
    own = rare.groupBy("v").agg(F.count(F.lit(1)).alias("low"), F.count(F.when(F.col("f") == 1, 1)).alias("alone"))
    known = materialize(t.join(own, "v", "left").withColumns({"c": F.col("n") - F.coalesce("low", F.lit(0)), "c1": F.col("n") - F.coalesce("alone", F.lit(0))}).drop("low", "alone"), "known")
    least = known.groupBy("bucket").agg(F.min("n").alias("least"))
    rows = known.join(least, "bucket").where(F.col("c") * (1 + similarity) >= similarity * (F.col("n") + F.col("least")) - 1e-6).drop("least")
    info = known.select("v", "t", "n", "c1", "root").distinct()
    shared = rare.where("f > 1").select("s", "v").join(info, "v")
    x, y = (shared.select("s", *(F.col(c).alias(c + k) for c in info.columns)) for k in ("", "2"))
    bound = F.least("c1", "c12") * (1 + similarity) >= similarity * (F.col("n") + F.col("n2")) - 1e-6
    return rows, _pair(x.join(y, "s").where((F.col("root") < F.col("root2")) & bound))


def links(docs: DataFrame, sigs: DataFrame, text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Verified links between different texts, enough to join all that are connected, and the components (v, root). sigs as of signed()."""
    one = sigs.where("v is not null").groupBy("v").agg(F.min(F.struct("t", "n", "keys")).alias("x"))
    table = one.select("v", "x.t", "x.n", F.explode("x.keys").alias("bucket")).withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("bucket"))).where("k > 1")
    table = materialize(table, "bands")
    pairs = materialize(_centred(table, similarity), "pairs")
    found = materialize(verified(docs, pairs, text, shingle, similarity), "links")
    root = components(found)
    left = materialize(_mixed(table, root), "mixed")
    for last in (False, True):
        if left.isEmpty():
            break
        if not last:
            able, rare = _able(left, docs, text, shingle, similarity)
            left = materialize(_mixed(able, root), "able")
            more = _centred(left, similarity).unionByName(rare).distinct()
        else:
            left = materialize(_mixed(left, root), "mixed")
            left = left.withColumn("buckets", F.collect_list("bucket").over(Window.partitionBy("v")))
            x, y = (left.select("bucket", *(F.col(c).alias(c + s) for c in ("v", "t", "n", "c", "root", "buckets"))) for s in ("", "2"))
            bound = F.least("c", "c2") * (1 + similarity) >= similarity * (F.col("n") + F.col("n2")) - 1e-6
            once = F.array_min(F.array_intersect("buckets", "buckets2")) == F.col("bucket")  # in the first bucket that they share
            more = _pair(x.join(y, "bucket").where((F.col("root") < F.col("root2")) & bound & once))
        more = materialize(more.join(pairs, ["a", "b"], "left_anti"), "pairs")
        if not more.isEmpty():
            pairs = pairs.unionByName(more)
            found = found.union(materialize(verified(docs, more, text, shingle, similarity), "links"))
            root = components(found)
    return found, root


def _classes(docs: DataFrame, key: str, text: str, shingle: int, similarity: float) -> DataFrame:
    """(k, t, v, root, class_id) of each row: key, hash of the text, vertex, class and its least key. Texts without a word have no vertex and no class."""
    sigs = materialize(signed(docs, key, text, shingle, M, ROWS), "signatures")
    _, root = links(docs, sigs, text, shingle, similarity)
    exact = sigs.where("v is not null").groupBy("v").agg(F.min("k").alias("m"))
    whole = exact.join(root, "v", "left").withColumn("root", F.coalesce("root", "v"))
    least = whole.groupBy("root").agg(F.min("m").alias("class_id"))
    classes = materialize(whole.join(least, "root").select("v", "root", "class_id"), "classes")
    return sigs.select("k", "t", "v").join(classes, "v", "left")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs' keys with class_id, the least key of the class, one row per row of docs.

    Null texts and texts without a word are alone in their class (class_id is their own key). Texts of fewer words than a shingle are
    one shingle of all their words. Repeated rows and exact copies share a class. A null key gets the least key of its class, or null.
    An empty table gives an empty table. Other columns of docs are not read.
    """
    rows = _classes(docs, key, text, shingle, similarity)
    return rows.select(F.col("k").alias(key), F.when(F.col("v").isNull(), F.col("k")).otherwise(F.col("class_id")).alias("class_id"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Keeps one row of each class: the one with its least key (a null key comes last), of equal keys the one with the least hash of the text. Rows that
    repeat it are dropped too. Texts without a word all stay, once for each key. Columns of docs pass through, whatever their names."""
    rows = materialize(_classes(docs, key, text, SHINGLE, SIMILARITY).select("k", "t", "root"), "rows")
    best = rows.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("k").isNull().alias("last"), "k", "t")).alias("x")).select("x.k", "x.t")
    k, t = fresh(docs.columns, "k", "t")
    keep = best.unionByName(rows.where("root is null").select("k", "t")).distinct().toDF(k, t)
    kept = docs.join(keep, F.col(key).eqNullSafe(F.col(k)) & (F.xxhash64(F.col(text)) == F.col(t)), "left_semi")
    return kept.dropDuplicates([key, text])
