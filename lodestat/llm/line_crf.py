"""Quality classifier (operator 10): a linear-chain conditional random field labels every line good or bad.

A line's features are its own, its predecessor's and its successor's shares of character classes, length, repetition and ending. A
document's quality is the mean of its lines' forward-backward marginals, weighted by length. Only documents have labels, so lines are
latent: the field is trained on a bounded sample of labelled documents so that this mean agrees with the label, GOOD_SHARE or BAD_SHARE of
the text. A bad document may thus have good lines, and lines that good documents have are held to be good wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.llm.common import held_out, materialize, sliced

#: Documents and lines of all of them that training uses at most; each document is used whole.
TRAIN_DOCS, TRAIN_LINES = 6000, 384_000
PREDICT = 0.7
#: The share of good text that documents labelled good and bad are expected to have.
GOOD_SHARE, BAD_SHARE = 0.97, 0.15
#: Ridge penalties of a line's own weights, and of its neighbours' and the transitions: context counts where a line itself says little.
OWN_PENALTY, CONTEXT_PENALTY = 1e-3, 0.05
_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#*$%&|<>", b"0123456789", b"!?", b".,;:'\"()-", b" \t\r\x0b\x0c", bytes(range(128, 256))]
_CLASS = np.full(256, 7, np.int64)
for _i, _c in enumerate(_CLASSES):
    _CLASS[list(_c)] = _i
OWN = 14


def own_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(lines x OWN features, lengths in bytes plus one) of a text; an empty text is one empty line."""
    raw = text.encode("utf-8", "replace")
    lines = raw.split(b"\n")
    n = np.array([len(x) for x in lines])
    line = np.repeat(np.arange(len(n)), n + 1)[: len(raw)]
    count = np.bincount(line * 8 + _CLASS[np.frombuffer(raw, np.uint8)], minlength=8 * len(n)).reshape(len(n), 8)
    share = count / np.maximum(n, 1)[:, None]
    more, seen = np.zeros((len(n), 6)), set()
    for i, x in enumerate(lines):
        ws = x.split()
        more[i] = (not ws, len(set(ws)) / len(ws) if ws else 0, min(len(ws), 50) / 50, x in seen and bool(ws), x[-1:] in b".?!\"'" and bool(ws), min(len(x) / len(ws), 20) / 20 if ws else 0)
        seen.add(x)
    return np.hstack([share, more]), n + 1


def line_features(own: np.ndarray) -> np.ndarray:
    """own with its neighbours' features (zeros at the ends), marks for both ends and a constant."""
    zero, ends = np.zeros((1, own.shape[1])), np.zeros((len(own), 3))
    ends[0, 0] = ends[-1, 1] = 1
    ends[:, 2] = 1
    return np.hstack([own, np.vstack([zero, own[:-1]]), np.vstack([own[1:], zero]), ends])


@dataclass
class Field:
    """Weights for good over bad, and transition weights [from, to]."""

    weights: np.ndarray
    transitions: np.ndarray

    def messages(self, u: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of forward (with u) and backward messages for padded rows of u, of lengths n."""
        t = self.transitions
        step = lambda x, a, b, c, d: np.logaddexp(x + a, b) - np.logaddexp(x + c, d)
        a, b = np.zeros_like(u), np.zeros_like(u)
        a[:, 0] = u[:, 0]
        for i in range(1, u.shape[1]):
            a[:, i] = u[:, i] + step(a[:, i - 1], t[1, 1], t[0, 1], t[1, 0], t[0, 0])
        for i in range(u.shape[1] - 2, -1, -1):
            b[:, i] = np.where(i + 1 < n, step(u[:, i + 1] + b[:, i + 1], t[1, 1], t[1, 0], t[0, 1], t[0, 0]), 0)
        return a, b

    def marginals(self, features: list[np.ndarray]) -> list[np.ndarray]:
        """P(good) of each line of each document; documents of like length are computed together."""
        out: list[np.ndarray] = [np.zeros(0)] * len(features)
        order = np.argsort([len(x) for x in features], kind="stable")
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end - at + 1) * len(features[order[end]]) <= 50_000 and len(features[order[end]]) <= 2 * len(features[order[at]]) + 4:
                end += 1
            rows = order[at:end]
            n = np.array([len(features[i]) for i in rows])
            u = np.zeros((len(rows), n.max()))
            for j, i in enumerate(rows):
                u[j, : n[j]] = features[i] @ self.weights
            a, b = self.messages(u, n)
            for j, i in enumerate(rows):
                out[i] = 1 / (1 + np.exp(-np.clip(a[j, : n[j]] + b[j, : n[j]], -500, 500)))
            at = end
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def gradient(field: Field, x: np.ndarray, share: np.ndarray, weight: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Gradient, by weights and then transitions, of the log likelihood of the wanted shares of good text in documents of n lines. x: documents x lines x
    features, weight: each line's part of its document's length, 0 beyond n. It runs back through the recursions of both messages."""
    t, u = field.transitions, (x.reshape(-1, x.shape[2]) @ field.weights).reshape(x.shape[:2])
    a, b = field.messages(u, n)
    p = _sigmoid(a + b)
    s = np.clip((weight * p).sum(axis=1), 1e-6, 1 - 1e-6)
    error = ((share / s - (1 - share) / (1 - s))[:, None] * weight) * p * (1 - p)
    da, db, du, dt = error.copy(), error.copy(), np.zeros_like(u), np.zeros((2, 2))
    for i in range(u.shape[1] - 1, 0, -1):  # a[i] = u[i] + f(a[i - 1])
        to1, to0 = _sigmoid(a[:, i - 1] + t[1, 1] - t[0, 1]), _sigmoid(a[:, i - 1] + t[1, 0] - t[0, 0])
        dt += [[-(da[:, i] @ (1 - to0)), da[:, i] @ (1 - to1)], [-(da[:, i] @ to0), da[:, i] @ to1]]
        da[:, i - 1] += da[:, i] * (to1 - to0)
    for i in range(1, u.shape[1]):  # b[i - 1] = g(u[i] + b[i]) within a document
        back = np.where(i < n, db[:, i - 1], 0)
        y = u[:, i] + b[:, i]
        from1, from0 = _sigmoid(y + t[1, 1] - t[1, 0]), _sigmoid(y + t[0, 1] - t[0, 0])
        dt += [[-(back @ (1 - from0)), -(back @ from0)], [back @ (1 - from1), back @ from1]]
        step = back * (from1 - from0)
        db[:, i] += step
        du[:, i] += step
    return np.concatenate([(du + da).ravel() @ x.reshape(-1, x.shape[2]), dt.ravel()])


def fit(features: list[np.ndarray], labels: np.ndarray, lengths: list[np.ndarray], steps: int = 150, rate: float = 0.1) -> Field:
    """Maximum likelihood by Adam, all documents at once, padded in buckets of like length; without both labels the field is even."""
    width = 3 * OWN + 3
    if len(set(labels.tolist())) < 2:
        return Field(np.zeros(width), np.zeros((2, 2)))
    size, buckets = np.array([len(x) for x in features]), []
    level = np.ceil(np.log2(size))
    share = np.where(np.asarray(labels) == 1, GOOD_SHARE, BAD_SHARE)
    for k in np.unique(level):
        rows = np.flatnonzero(level == k)
        n = size[rows]
        x, weight = np.zeros((len(n), n.max(), width)), np.zeros((len(n), n.max()))
        for j, i in enumerate(rows):
            x[j, : n[j]], weight[j, : n[j]] = features[i], lengths[i] / lengths[i].sum()
        buckets.append((x, share[rows], weight, n))
    penalty = np.full(width + 4, OWN_PENALTY)
    penalty[OWN : 3 * OWN] = penalty[width:] = CONTEXT_PENALTY
    theta, m, v = np.zeros(width + 4), np.zeros(width + 4), np.zeros(width + 4)
    for k in range(1, steps + 1):
        field = Field(theta[:width], theta[width:].reshape(2, 2))
        grad = sum(gradient(field, *bucket) for bucket in buckets) / len(size) - penalty * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return Field(theta[:width], theta[width:].reshape(2, 2))


def chosen(sizes: list[tuple], lines: int) -> list:
    """Keys of (key, label, lines), in their order, that training uses: up to half of the lines for each label. A document that alone has
    more than a sixteenth of all lines, or that no longer fits, is passed over, and the next is looked at; a label that has no other
    document gets its shortest, if it alone has no more than all lines. Where nothing at all would be left, each label gets its shortest."""
    out, shortest = [], []
    for y in (0, 1):
        own, left = [(k, n) for k, label, n in sizes if label == y], lines // 2
        kept = []
        for k, n in own:
            if n <= min(left, max(1, lines // 16)):
                kept.append(k)
                left -= n
        least = sorted(own, key=lambda x: x[1])[:1]
        shortest += [k for k, _ in least]
        out += kept or [k for k, n in least if n <= lines]
    return out or shortest


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = TRAIN_DOCS, lines: int = TRAIN_LINES) -> Field:
    """Fits the field on `most` labelled documents at most, half of them of each label, those with the least hashes of the key, each whole; of
    these, on those that chosen() takes for `lines` lines. Of rows that repeat a key, the one with the least hash of the text counts. The
    sample bounds what the driver holds; fitting uses its whole texts."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("y"))
    there = docs.select(key).distinct().join(known, key)
    half = lambda y: there.where(F.col("y") == y).orderBy(F.xxhash64(key), key).limit(most // 2)
    ids = half(0).union(half(1))
    t = F.coalesce(F.col(text), F.lit(""))
    one = docs.select(key, t.alias("t")).join(F.broadcast(ids), key).groupBy(F.col(key).alias("k"), F.col("y").cast("int").alias("y")).agg(F.min_by("t", F.xxhash64("t")).alias("t"))
    one = materialize(one, "sample")
    sizes = one.select("k", "y", (F.length("t") - F.length(F.replace("t", F.lit("\n"), F.lit(""))) + 1).alias("n")).orderBy(F.xxhash64("k"), "k").collect()
    used = docs.sparkSession.createDataFrame([(k,) for k in chosen([tuple(r) for r in sizes], lines)], f"k {docs.schema[key].dataType.simpleString()}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "t", 4_000_000):
            own = [own_features(t) for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("y"), pa.array([x.ravel() for x, _ in own], pa.list_(pa.float64())), pa.array([n for _, n in own], pa.list_(pa.int64()))], names=["k", "y", "x", "n"])

    kind = docs.schema[key].dataType.simpleString()
    sample = one.join(F.broadcast(used), "k")
    got = sorted(sample.mapInArrow(run, f"k {kind}, y int, x array<double>, n array<long>").collect(), key=lambda r: r.k)
    return fit([line_features(np.array(r.x).reshape(-1, OWN)) for r in got], np.array([r.y for r in got]), [np.array(r.n, float) for r in got])


def classify(docs: DataFrame, field: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, n_lines, bad_lines): the length-weighted mean of the lines' P(good), and how many lines are rather bad."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "t", 1_500_000):
            own = [own_features(t) for t in b.column("t").to_pylist()]
            good = field.marginals([line_features(x) for x, _ in own])
            score = [float(min(1.0, max(0.0, p @ n / n.sum()))) for p, (_, n) in zip(good, own, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(score, pa.float64()), pa.array([len(p) for p in good], pa.int64()), pa.array([int((p < 0.5).sum()) for p in good], pa.int64())], names=["k", "score", "n_lines", "bad_lines"])

    out = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return out.mapInArrow(run, f"k {kind}, score double, n_lines long, bad_lines long").withColumnRenamed("k", key)


def quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", cut: float = PREDICT) -> DataFrame:
    """Trains on rows that are not held out (crc32(key) mod 4 is not 2) and scores every row: key, held_out, score, predicted.

    Null and empty texts are one empty line. Rows with a null key are scored, never learned from. Repeated rows get equal rows; of labels that
    repeat a key the highest counts. Without both labels every score is 0.5. An empty table gives an empty table. Other columns are not read.
    """
    out = held_out(F.col(key), 4)
    field = train(docs.where(~out), labels, key, text)
    return classify(docs, field, key, text).withColumns({"held_out": out, "predicted": (F.col("score") >= cut).cast("int")})
