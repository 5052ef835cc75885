"""Language ID (operator 7): every document is a mixture of languages.

Each language is a multinomial over hashed byte n-grams (orders ORDERS) of the lower-cased letters, learned from all labelled training
rows. Expectation-maximisation finds a document's proportions from the n-gram likelihoods; the languages in it are the set with the best
likelihood less PENALTY * log(n-grams) for each language. The prediction is the language with the largest share of that set.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.llm.common import held_out, sliced

BITS, ALPHA, PENALTY = 15, 0.5, 2.0
#: How near EM comes to the greatest log-likelihood, and the number of languages up to which all sets are tried.
GAP, ALL_SETS = 0.05, 6
#: Everything in ASCII but a-z becomes a blank.
_LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def gram_counts(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's byte trigrams and pairs, and their counts."""
    raw = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split()) + b" "
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(0)
    pair = b[:-1] << np.uint32(8) | b[1:]
    g = np.concatenate([pair * np.uint32(0x9E3779B1), (pair[:-1] << np.uint32(8) | b[2:]) * np.uint32(0x85EBCA6B)]) >> np.uint32(32 - bits)
    count = np.bincount(g, minlength=1 << bits)
    at = np.flatnonzero(count)
    return at, count[at].astype(float)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", bits: int = BITS) -> tuple[list[str], np.ndarray]:
    """Languages and log p(bucket | language), from all rows with a language. At most languages * 2**bits counts reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for t, name in zip(b.column("t").to_pylist(), b.column("l").to_pylist(), strict=True):
                at, n = gram_counts(t, bits)
                total.setdefault(name, np.zeros(1 << bits))[at] += n
        for name, count in total.items():
            at = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at), pa.array(count[at].astype(np.int64))], names=["l", "b", "n"])

    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("l"))
    got = known.mapInArrow(run, "l string, b long, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    names = sorted(set(got["l"]))
    table = np.full((1 << bits, len(names)), ALPHA)
    place = {x: i for i, x in enumerate(names)}
    np.add.at(table, (np.array(got["b"], np.int64), np.array([place[x] for x in got["l"]], np.int64)), np.array(got["n"], float))
    return names, np.log(table / table.sum(axis=0)) if names else table


def mixture(at: np.ndarray, n: np.ndarray, log_p: np.ndarray, penalty: float = PENALTY, within: float = GAP) -> np.ndarray:
    """Shares of the languages in a document; those outside the set of best penalised likelihood have 0.

    EM goes on until the log-likelihood is `within` reach of its maximum: the largest factor by which a share would grow bounds what can still be
    gained. The same bound ends the search for sets that cannot win; that of all languages rules out every set of several at once for most
    documents. Up to ALL_SETS languages every set is tried, beyond it those that are left when the smallest share goes, one after another."""
    own = log_p[at]
    single = n @ own
    top = own.max(axis=1)
    p, total, most = np.exp(own - top[:, None]), n.sum(), n @ top
    cost = penalty * np.log(total + 1)

    def shares(chosen: tuple[int, ...], size: int, value: float) -> tuple[np.ndarray, float] | None:
        """Shares and likelihood of a set; None if it is certain that less the cost of `size` languages it does not exceed value."""
        q, part = np.full(len(chosen), 1 / len(chosen)), p[:, chosen]
        while True:
            mix = np.maximum(part @ q, 1e-300)
            grow = part.T @ (n / mix) / total
            fit_, gap = float(n @ np.log(mix) + most), float(total * np.log(max(grow.max(), 1.0)))
            if fit_ + gap - size * cost <= value:
                return None
            if gap < within:
                return q, fit_
            q = q * grow / (q @ grow)

    count = log_p.shape[1]
    out, best = np.zeros(count), int(single.argmax())
    out[best], value = 1.0, single[best] - cost
    every = tuple(range(count))
    found = shares(every, 2, value) if count > 1 else None
    if found is None:
        return out
    if count <= ALL_SETS:
        sets = [c for k in range(2, count + 1) for c in combinations(every, k)]
    else:
        sets, q = [every], found[0]
        while len(sets[-1]) > 2:
            sets.append(tuple(x for x, _ in sorted(zip(sets[-1], q, strict=True), key=lambda y: -y[1])[:-1]))
            q = shares(sets[-1], 0, -np.inf)[0]
    for chosen in sets:
        found = shares(chosen, len(chosen), value)
        if found is not None and found[1] - len(chosen) * cost > value:
            value, out = found[1] - len(chosen) * cost, np.zeros(count)
            out[list(chosen)] = found[0]
    return out


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, mixture): the main language, its share and the shares of all languages found."""
    names, log_p = model
    sent = docs.sparkSession.sparkContext.broadcast(log_p)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "t", 8_000_000):
            rows = []
            for t in b.column("t").to_pylist():
                at, n = gram_counts(t, int(np.log2(len(sent.value)))) if names and has_letter(t) else ([], [])
                if not len(at):
                    rows.append(("und", 0.0, []))
                    continue
                share = mixture(at, n, sent.value)
                top = int(share.argmax())
                rows.append((names[top], float(min(1.0, share[top])), [(names[i], float(share[i])) for i in np.flatnonzero(share)]))
            lang, score, mix_ = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array([[{"lang": a, "share": s} for a, s in m] for m in mix_], pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))], names=["k", "lang_pred", "score", "mixture"])

    out = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, lang_pred string, score double, mixture array<struct<lang:string,share:double>>")
    return out.withColumnRenamed("k", key)


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learns from rows that are not held out (crc32(key) mod 4 is not 2) and predicts every row: key, held_out, lang_pred, score, mixture.

    Null texts and texts without a letter are "und" with score 0. Rows without a language are not learned from. Ties go to the first language
    in sorted order. Repeated rows get equal rows. Without a labelled row all are "und"; an empty table gives an empty table.
    """
    out = held_out(F.col(key), 4)
    model = fit(docs.where(~out), text, lang)
    return predict(docs.select(key, text), model, key, text).withColumn("held_out", out)
