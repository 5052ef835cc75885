"""Quality rules (operator 9, native): plain rules, then the hashed n-gram log-likelihood ratio of a trusted target and the raw corpus.

Both corpora are multinomials over `BUCKETS` hashed word unigrams and bigrams with add-`ALPHA` smoothing. A document's score is the
mean over its n-grams of log p_target(g) - log p_raw(g); it is kept if no plain rule fails and the score reaches the threshold. Scores
depend on the size of the corpus, so the threshold is calibrated in each run: it separates the rows labelled bad from trusted rows
that are held out of the target, as rows that the target has learnt score higher than equally good ones.
The counts cover every row; the model is one weight a bucket, so its size is fixed and it rides along as a literal.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.llm.common import held_out, let, materialize, small, word_hashes, words

BUCKETS, ALPHA, THRESHOLD = 1 << 16, 1.0, -0.5
#: Of trusted keys, one in HELD is held out of the target for the threshold. Scores are cut into bins of this width for it, between -LIMIT and LIMIT.
HELD, BIN, LIMIT = 5, 0.005, 10.0
MIN_WORDS, REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeat_words(hashes: Column) -> Column:
    """Words that lie in 3-word windows found twice or more, from the hashes of a text's words. Sorting brings equal windows together."""

    def covered(s: Column) -> Column:
        same = lambda x, j: F.coalesce(x.g == F.get(s, j).g, F.lit(False))
        starts = F.filter(F.transform(s, lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x.i)), lambda i: i.isNotNull())
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))

    def windows(h: Column) -> Column:
        starts = F.slice(h, 1, F.greatest(F.size(h) - 2, F.lit(0)))
        return F.transform(starts, lambda x, i: F.struct(F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)).alias("g"), i.alias("i")))

    return let(F.array_sort(let(hashes, windows)), covered).cast("long")


def base_columns(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and _h (word hashes)."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (
        df.withColumn("_h", word_hashes(words(F.col(text))))
        .withColumns({
            "n_words": F.size("_h").cast("long"),
            "word_chars": F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": repeat_words(F.col("_h")),
        })
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))
    )


def grams(hashes: Column, buckets: int) -> Column:
    """Buckets of all unigrams and bigrams."""
    both = lambda h: F.concat(F.transform(h, lambda x: F.pmod(x, F.lit(buckets))), F.transform(F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))), lambda y, i: F.pmod(F.xxhash64(F.get(h, i), y), F.lit(buckets))))
    return let(hashes, both)


def fit(docs: DataFrame, trusted: DataFrame, text: str = "text", key: str = "doc_id", buckets: int = BUCKETS, alpha: float = ALPHA) -> list[float]:
    """One weight a bucket: log of the ratio of the smoothed probabilities in the trusted rows and in all rows. trusted has the keys
    of the trusted rows; if none of them is in docs, all weights are 0."""
    keys = small(materialize(trusted.select(F.col(key).alias("_k")).where("_k is not null").distinct(), "trusted"))
    marked = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).join(keys.withColumn("_in", F.lit(True)), "_k", "left")
    one = marked.select(F.explode(grams(word_hashes(words(F.col("_t"))), buckets)).alias("b"), F.col("_in").isNotNull().cast("long").alias("t"))
    rows = one.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("t")).collect()  # at most `buckets` rows
    n, t = sum(r.n for r in rows), sum(r.t for r in rows)
    if not t:
        return [0.0] * buckets
    log = lambda c, all_: math.log((c + alpha) / (all_ + alpha * buckets))
    out = [log(0, t) - log(0, n)] * buckets
    for r in rows:
        out[r.b] = log(r.t, t) - log(r.n, n)
    return [round(x, 4) for x in out]


def ratio(hashes: Column, weights: list[float]) -> Column:
    """Mean weight of the n-grams of a text; 0 without words. The weights are a constant that the optimiser folds."""
    table = F.split(F.lit(",".join(f"{x:g}" for x in weights)), ",").cast("array<double>")
    total = lambda g: let(table, lambda t: F.aggregate(g, F.lit(0.0), lambda a, b: a + F.get(t, b.cast("int")))) / F.greatest(F.size(g), F.lit(1))
    return F.round(let(grams(hashes, len(weights)), total), 6)


def calibrate(scores: DataFrame) -> float | None:
    """The score that separates good from bad best, by the sum of both error rates; of the bins that do so equally well in a row, the
    middle. scores: score, good. At most 2 * LIMIT / BIN bins reach the driver. Without one of the two classes it is null."""
    b = F.floor(F.greatest(F.least("score", F.lit(LIMIT)), F.lit(-LIMIT)) / BIN).alias("b")
    bins = scores.groupBy(b).agg(F.sum(F.col("good").cast("long")).alias("g"), F.sum((~F.col("good")).cast("long")).alias("r")).orderBy("b").collect()
    ng, nr = sum(x.g for x in bins), sum(x.r for x in bins)
    if not ng or not nr:
        return None
    best, least, most, lost, kept = 2.0, 0.0, 0.0, 0, nr
    below = bins[0].b
    for x in bins:  # a threshold above `below` and up to x.b loses the good rows and keeps the bad ones counted so far
        if (error := lost / ng + kept / nr) < best - 1e-12:
            best, least, most = error, below, x.b
        lost, kept, below = lost + x.g, kept - x.r, x.b + 1
    return round((least + most) / 2 * BIN, 6)


def quality_rules(docs: DataFrame, trusted: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD, rejected: DataFrame | None = None) -> DataFrame:
    """docs with the base columns, score and kept.

    With rejected, the keys of rows labelled bad, the threshold is calibrated; the given one counts where no such row, or no held-out trusted one, passes the
    plain rules. Keys that are trusted too are not rejected. Null and empty texts have no words, so base_failed is true. Repeated rows each get their own
    equal verdict. An empty table gives an empty table. Columns of docs with the names of added ones are replaced, others
    pass through, whatever their names. Rows with a null key are scored but never trusted.
    """
    out = held_out(F.col(key), HELD)
    weights = fit(docs, trusted if rejected is None else trusted.where(~out), text, key)
    passed = docs.drop(*BASE, "base_failed", "score", "kept")
    packed = docs.select(F.struct(*(passed[c] for c in passed.columns)).alias("row"), F.col(key).alias("k"), F.col(text).alias("text"))
    scored = base_columns(packed, "text").withColumn("score", ratio(F.col("_h"), weights)).select("row", "k", *BASE, "base_failed", "score")
    if rejected is not None:
        scored = materialize(scored, "scored")
        known = rejected.select(F.col(key).alias("k"), F.lit(False).alias("good")).union(trusted.select(F.col(key).alias("k"), F.lit(True).alias("good")))
        known = small(materialize(known.groupBy("k").agg(F.max("good").alias("good")).where(~F.col("good") | held_out(F.col("k"), HELD)), "known"))
        found = calibrate(scored.where(~F.col("base_failed")).select("k", "score").join(known, "k"))
        threshold = threshold if found is None else found
    return scored.select("row.*", *BASE, "base_failed", "score", (~F.col("base_failed") & (F.col("score") >= threshold)).alias("kept"))


def trusted_rows(labels: DataFrame) -> DataFrame:
    """Keys of rows that people labelled good and, where they judged that, not toxic."""
    good = F.col("quality") == 1
    return labels.where(good & ~F.coalesce(F.col("toxic") == 1, F.lit(False)) if "toxic" in labels.columns else good).select("doc_id")


def rejected_rows(labels: DataFrame) -> DataFrame:
    """Keys of rows that people labelled bad."""
    return labels.where("quality = 0").select("doc_id")
