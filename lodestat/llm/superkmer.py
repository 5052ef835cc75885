"""Substring dedup (operator 6): repeated windows of WIDTH words, found by super-k-mers.

Words become 64-bit hashes. Each window has a minimiser, the least hash of the runs of MINIMISER words in it. Consecutive windows with
the same minimiser travel as one packed string to that minimiser's bucket, where their 128-bit digests are sorted and counted, so each
window's count is that of the whole corpus. Equal windows always share a minimiser, hence:

* a first, thin pass counts minimisers, and a window whose minimiser occurs once needs no shuffle. What occurs more often is marked in
  a bit map, sized by their number up to 2**MOST_BITS bits, the only thing broadcast; a wrong bit costs some shuffle and never changes a result.
* equal packed strings that a task holds at once are repeated for sure: they are reported there, and one of them travels for all.
* minimisers that are frequent all the same (HEAVY strings) are split by a second minimiser of LONGER words; windows still travel packed.
* where a bucket is larger than a task should hold even then, its windows go on as digests and Spark adds them up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.llm.common import fresh, materialize, mix, ragged, rolling, sliced, word_hashes, words

WIDTH, MINIMISER, LONGER, HEAVY, MOST_BITS = 35, 8, 20, 5000, 28
#: Packed strings, and bytes of them, that a task holds of one bucket.
BUCKET_ROWS, BUCKET_BYTES = 100_000, 48_000_000
_SECOND = 0xC2B2AE3D27D4EB4F


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """Place of the least of values[i:i+span] for each i. The low bits of what is compared hold the place, so of equal values it is the leftmost."""
    low, reach = np.uint64((1 << max(1, len(values).bit_length())) - 1), 1
    least = values & ~low | np.arange(len(values), dtype=np.uint64)
    while reach < span:
        step = min(reach, span - reach)
        least[: len(least) - step] = np.minimum(least[: len(least) - step], least[step:])
        reach += step
    return (least & low).astype(np.int64)


def super_kmers(h: np.ndarray, offsets: np.ndarray, width: int, minimiser: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, windows, minimiser) of each run of windows that share one minimiser at one place, over concatenated documents. So two
    equal windows are never in the same super-k-mer, and none has more than width - minimiser + 1 windows."""
    n = np.diff(offsets)
    doc = np.repeat(np.arange(len(n)), n)
    starts = np.flatnonzero(np.arange(len(h)) + width <= offsets[1:][doc]) if len(h) >= width else np.zeros(0, np.int64)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    values = mix(rolling(h, minimiser))
    d, at = doc[starts], _least(values, width - minimiser + 1)[starts]
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return d[new], starts[new] - offsets[:-1][d[new]], np.diff(np.append(new, len(starts))), mix(values[at[new]])


def split(h: np.ndarray, offsets: np.ndarray, found: tuple[np.ndarray, ...], width: int, longer: int) -> tuple[np.ndarray, ...]:
    """The windows of some super-k-mers, cut again where their minimiser of `longer` words changes; the new key depends on both minimisers."""
    doc, start, windows, m = found
    values = mix(rolling(h, longer, _SECOND))
    row = np.repeat(np.arange(len(doc)), windows)
    place = np.arange(len(row)) + np.repeat(offsets[doc] + start - np.cumsum(windows) + windows, windows)
    at = _least(values, width - longer + 1)[place]
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (at[1:] != at[:-1])])) if len(row) else row
    r = row[new]
    return doc[r], place[new] - offsets[doc[r]], np.diff(np.append(new, len(row))), mix(m[r] ^ mix(values[at[new]]))


def _alike(one: np.ndarray, two: np.ndarray, first: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, copies): an order that brings equal packed strings together, and for each string there, the number of its copies if it is
    the first of them, else 0. First and last window cover a string, so their digests name it."""
    a, b = one[first] ^ mix(one[first + windows - 1] + windows.astype(np.uint64)), two[first] ^ mix(two[first + windows - 1] + windows.astype(np.uint64))
    order = np.lexsort((b, a))
    new = np.flatnonzero(np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])) if len(a) else order
    copies = np.zeros(len(a), np.int64)
    copies[new] = np.diff(np.append(new, len(a)))
    return order, copies


def _hashed(docs: DataFrame, text: str, key: str, width: int) -> DataFrame:
    return docs.select(F.col(key).alias("k"), F.xxhash64(F.col(text)).alias("t"), word_hashes(words(F.col(text))).alias("h")).where(F.size("h") >= width)


def _bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """Sets bit key >> (64 - bits) for each key: at most 2**(bits - 6) rows reach the driver, whatever the input."""
    place = F.shiftrightunsigned("m", 64 - bits)
    rows = keys.withColumn("_p", place).selectExpr("shiftright(_p, 6) as w", "shiftleft(1L, cast(_p & 63 as int)) as b")
    got = rows.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[got.column("w").to_numpy()] = got.column("b").to_numpy().view(np.uint64)
    return out


def _marked(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys >> np.uint64(64 - 6 - int(np.log2(len(bitmap))))
    return (bitmap[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def _bits(n: int) -> int:
    return min(MOST_BITS, max(16, (8 * n).bit_length()))


def minimiser_counts(docs: DataFrame, text: str, key: str, width: int = WIDTH, minimiser: int = MINIMISER) -> DataFrame:
    """(m, n): packed strings of each minimiser; copies of a string in one slice of a task count as two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "h", 2_000_000):
            h, offsets = ragged(b.column("h"))
            doc, start, windows, m = super_kmers(h, offsets, width, minimiser)
            order, copies = _alike(rolling(h, width), rolling(h, width, _SECOND), offsets[doc] + start, windows)
            m = m[order][copies > 0]
            order = np.argsort(m, kind="stable")
            m, n = m[order], np.minimum(copies[copies > 0], 2)[order]
            new = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]])) if len(m) else order
            yield pa.RecordBatch.from_arrays([pa.array(m[new].view(np.int64)), pa.array(np.add.reduceat(n, new) if len(m) else n)], names=["m", "n"])

    return _hashed(docs, text, key, width).select("h").mapInArrow(run, "m long, n long").groupBy("m").agg(F.sum("n").alias("n"))


def occurrences(docs: DataFrame, text: str, key: str, often, heavy, width: int, minimiser: int, longer: int) -> DataFrame:
    """(k, t, start, len, m, packed, n) for super-k-mers whose minimiser is marked as often. packed is the words' hashes, 8 bytes each, and n says
    whether the string stands for one or for several. Rows without packed are spans already known to be repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "h", 2_000_000):
            h, offsets = ragged(b.column("h"))
            found = super_kmers(h, offsets, width, minimiser)
            found = tuple(x[_marked(often.value, found[3])] for x in found)
            if heavy is not None and (hot := _marked(heavy.value, found[3])).any():
                cut = split(h, offsets, tuple(x[hot] for x in found), width, longer)
                found = tuple(np.concatenate([x[~hot], y]) for x, y in zip(found, cut, strict=True))
            doc, start, windows, m = found
            order, copies = _alike(rolling(h, width), rolling(h, width, _SECOND), offsets[doc] + start, windows)
            doc, start, windows, m = (x[order] for x in (doc, start, windows, m))
            sent = np.flatnonzero(copies)
            known = np.flatnonzero(np.repeat(copies[sent], copies[sent]) > 1)
            size, raw = windows + width - 1, h.tobytes()
            at = (offsets[doc] + start)[sent]
            packed = [raw[8 * a : 8 * e] for a, e in zip(at, at + size[sent], strict=True)]
            for rows, n, strings, keys in ((sent, np.minimum(copies[sent], 2), pa.array(packed, pa.binary()), m[sent]), (known, np.full(len(known), 2), pa.nulls(len(known), pa.binary()), mix(np.arange(len(known), dtype=np.uint64)))):
                take = pa.array(doc[rows], pa.int64())
                cols = [b.column("k").take(take), b.column("t").take(take), *(pa.array(x) for x in (start[rows], size[rows], keys.view(np.int64))), strings, pa.array(n)]
                yield pa.RecordBatch.from_arrays(cols, names=["k", "t", "start", "len", "m", "packed", "n"])

    kind = docs.schema[key].dataType.simpleString()
    return _hashed(docs, text, key, width).mapInArrow(run, f"k {kind}, t long, start long, len long, m long, packed binary, n long")


def _windows(packed: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, window, digest, second digest) of all windows of packed strings."""
    values = packed.to_pylist()
    size = np.fromiter(map(len, values), np.int64, len(values)) // 8
    h = np.frombuffer(b"".join(values), np.uint64)
    ends = np.cumsum(size)
    row = np.repeat(np.arange(len(size)), size)
    at = np.flatnonzero(np.arange(len(h)) + width <= ends[row])
    return row[at], at - (ends - size)[row[at]], rolling(h, width)[at], rolling(h, width, _SECOND)[at]


def _spans(row: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring windows of a row as (row, first, words covered)."""
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)])) if len(row) else np.zeros(0, np.int64)
    return row[new], at[new], np.diff(np.append(new, len(row))) + width - 1


def count_buckets(found: DataFrame, width: int, most: int = BUCKET_ROWS) -> DataFrame:
    """(k, t, start, len, d, e, n) from occurrences(), dealt out by minimiser: spans of windows that occur twice or more, and windows of overfull
    buckets with their digests d and e. A task walks through its rows in order of minimiser and holds `most` of them at most."""

    def out(rows: pa.RecordBatch, r: np.ndarray, start: np.ndarray, size: np.ndarray, d: pa.Array | None = None, e: pa.Array | None = None) -> pa.RecordBatch:
        take, none = pa.array(r, pa.int64()), pa.nulls(len(r), pa.int64())
        cols = [rows.column("k").take(take), rows.column("t").take(take), pa.array(start), pa.array(size), none if d is None else d, none if e is None else e, rows.column("n").take(take)]
        return pa.RecordBatch.from_arrays(cols, names=["k", "t", "start", "len", "d", "e", "n"])

    def repeated(rows: pa.RecordBatch) -> pa.RecordBatch:
        row, at, one, two = _windows(rows.column("packed"), width)
        order = np.lexsort((two, one))
        same = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
        hit = np.zeros(len(row), bool)
        hit[order[1:][same]] = hit[order[:-1][same]] = True
        r, a, n = _spans(row[hit], at[hit], width)
        return out(rows, r, rows.column("start").to_numpy()[r] + a, n)

    def later(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for s in (rows.slice(i, 5000) for i in range(0, rows.num_rows, 5000)):
            row, at, one, two = _windows(s.column("packed"), width)
            yield out(s, row, s.column("start").to_numpy()[row] + at, np.full(len(row), width), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)))

    def joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        over = None  # the minimiser whose bucket is overfull
        for b in batches:
            known = b.filter(pc.is_null(b.column("packed")))
            yield out(known, np.arange(known.num_rows), known.column("start").to_numpy(), known.column("len").to_numpy())
            b = b.filter(pc.is_valid(b.column("packed")))
            if over is not None:
                n = int(np.argmin(np.append(b.column("m").to_numpy() == over, False)))
                yield from later(b.slice(0, n))
                b = b.slice(n)
                over = over if not b.num_rows else None
            if not b.num_rows:
                continue
            held.append(b)
            if sum(x.num_rows for x in held) > most or sum(x.nbytes for x in held) > BUCKET_BYTES // 4:
                rows = joined(held)
                m = rows.column("m").to_numpy()
                cut = int(np.argmax(m == m[-1]))
                if cut:
                    yield repeated(rows.slice(0, cut))
                    rows = joined([rows.slice(cut)])
                if rows.num_rows > most or rows.nbytes > BUCKET_BYTES:
                    yield from later(rows)
                    held, over = [], m[-1]
                else:
                    held = [rows]
        if held:
            yield repeated(joined(held))

    kind = found.schema["k"].dataType.simpleString()
    return found.repartition("m").sortWithinPartitions("m").mapInArrow(run, f"k {kind}, t long, start long, len long, d long, e long, n long")


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, minimiser: int = MINIMISER, longer: int = LONGER, heavy: int = HEAVY, most: int = BUCKET_ROWS) -> DataFrame:
    """(k, t, start, len): words to remove, by key and hash of the text; spans of one text may overlap."""
    counts = materialize(minimiser_counts(docs, text, key, width, minimiser).where("n > 1"), "minimisers")
    sc, hot = docs.sparkSession.sparkContext, counts.where(F.col("n") > heavy).select("m")
    n, n_hot = counts.select(F.count(F.lit(1)), F.coalesce(F.sum((F.col("n") > heavy).cast("long")), F.lit(0))).first()
    often = sc.broadcast(_bitmap(counts.select("m"), _bits(n)))
    frequent = sc.broadcast(_bitmap(hot, _bits(n_hot))) if n_hot else None
    found = materialize(count_buckets(occurrences(docs, text, key, often, frequent, width, minimiser, longer), width, most), "spans")
    left = found.where("d is not null")
    twice = left.groupBy("d", "e").agg(F.sum("n").alias("n")).where("n > 1").select("d", "e")
    return found.where("d is null").unionByName(left.join(twice, ["d", "e"], "left_semi")).select("k", "t", "start", "len").distinct()


def _cut(text: str | None, starts, lens) -> tuple[int, int, str, str]:
    """(words, removed, kept words joined by a space, text without the removed words and the white space after them)."""
    data = (text or "").encode("utf-8", "surrogatepass")
    ws = data.split()
    gone = np.zeros(len(ws) + 1, np.int64)
    np.add.at(gone, np.asarray(starts, np.int64), 1)
    np.add.at(gone, np.asarray(starts, np.int64) + np.asarray(lens, np.int64), -1)
    gone = np.cumsum(gone[:-1]) > 0
    kept = b" ".join(w for w, g in zip(ws, gone, strict=True) if not g)
    if not gone.any():
        return len(ws), 0, kept.decode("utf-8", "replace"), text or ""
    parts = [m.group() for m in re.finditer(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", data)]
    return len(ws), int(gone.sum()), kept.decode("utf-8", "replace"), b"".join(w for w, g in zip(parts, gone, strict=True) if not g).decode("utf-8", "replace")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, **more) -> DataFrame:
    """Rows of docs with n_words, n_removed, kept (the words left, joined by a space) and the text without removed words.

    Every word in a window whose word sequence starts anywhere else too is removed, the first occurrence as well; windows are judged on
    the input. Null and empty texts have no words and stay empty (null becomes empty). A repeated row repeats all its windows, so both
    lose them. Texts under `width` words are unchanged. Null keys are kept. An empty table gives an empty table. Columns n_words, n_removed
    and kept of docs are replaced, others pass through, whatever their names.
    """
    own = docs.drop("n_words", "n_removed", "kept")
    columns = own.columns
    k, t, starts, lens = fresh(columns, "k", "t", "starts", "lens")
    spans = repeated_spans(docs, key, text, width, **more).groupBy("k", "t").agg(F.collect_list("start").alias(starts), F.collect_list("len").alias(lens))
    spans = spans.select(F.col("k").alias(k), F.col("t").alias(t), starts, lens)
    joined = own.join(spans, F.col(key).eqNullSafe(F.col(k)) & (F.xxhash64(F.col(text)) == F.col(t)), "left").drop(k, t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, text, 8_000_000):
            rows = [_cut(t, s or (), n or ()) for t, s, n in zip(*(b.column(c).to_pylist() for c in (text, starts, lens)), strict=True)]
            n_words, n_removed, kept, left = zip(*rows, strict=True)
            own_cols = [pa.array(left, pa.string()) if c == text else b.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*own_cols, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=[*columns, "n_words", "n_removed", "kept"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    return joined.mapInArrow(run, f"{schema}, n_words long, n_removed long, kept string")


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, n_words, n_removed and the SHA-256 of the kept words."""
    out = remove_repeats(docs.select(key, text), key, text)
    return out.select(key, "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, [x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, unnest([md5(array_to_string(w[i : i + 34], ' ')) FOR i IN range(1, len(w) - 33)]) AS g FROM d WHERE len(w) >= 35),
again AS (SELECT g FROM g GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM g SEMI JOIN again USING (g)),
p AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY j) AS kept FROM p ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
