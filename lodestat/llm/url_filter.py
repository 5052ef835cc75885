"""URL filters (operator 2, native): domain and path rules, then the ratio of two character language models.

Both models are variable-order Markov models over a fixed alphabet of 40 symbols (a-z, digits as one, punctuation, the rest), with
contexts of up to ORDER symbols and Witten-Bell smoothing towards the next shorter context. They learn from the urls that the rules
allow and block, but for one in HELD, on which the threshold is set that separates the two best. A url's score is its log-likelihood
difference divided by its length. The table of distinct grams has at most ALPHABET ** (ORDER + 1) rows whatever the input (2,560,000, some
150 MB), and is broadcast after it is counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.llm.common import UPPER, LOWER, let, materialize, small

ORDER, ALPHABET, HELD = 3, 40, 5
#: The rules of the contract, as (host, path, verdict).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Scores are cut into bins of this width for the threshold, between -LIMIT and LIMIT.
BIN, LIMIT = 0.01, 10.0


def host_of(url: Column) -> Column:
    """What lies between the first :// and the next /, ? or #, with A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null; the last of equals. A rule fits its host and all subdomains."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))).otherwise(out)
    return out


def symbols(url: Column) -> Column:
    """The url in the models' alphabet: "0" stands for any digit, "*" for every symbol outside it; "^" is what comes before a url."""
    low = F.regexp_replace(F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER), "[0-9]", "0")
    return F.regexp_replace(low, "[^a-z0/.:_?=&%#~+-]", "*")


def grams(url: Column, order: int) -> Column:
    """For each symbol, it and the `order` symbols before it, in time linear in the url's length."""

    def cut(s: Column) -> Column:
        at = F.when(F.size(s) > order, F.sequence(F.lit(0), F.size(s) - order - 1))
        return F.transform(at, lambda i: F.concat(*(F.get(s, i + j) for j in range(order + 1))))

    return let(F.split(F.concat(F.lit("^" * order), symbols(url)), ""), cut)


def model(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """(g, w) for every gram of urls(url, verdict): w = log p_accepted - log p_rejected of its last symbol in its context. Urls without a verdict
    are not counted; a gram that only they have backs off to its last symbols."""
    each = urls.select(F.explode(grams(F.col("url"), order)).alias("g"), (F.col("verdict") == "allow").cast("int").alias("a"), (F.col("verdict") == "block").cast("int").alias("r"))
    full = materialize(each.groupBy("g").agg(F.sum(F.coalesce("a", F.lit(0))).alias("a"), F.sum(F.coalesce("r", F.lit(0))).alias("r")), "grams")
    below = None
    for k in range(order + 1):
        tail = F.substring("g", order + 1 - k, k + 1)
        count = full.groupBy(tail.alias("g")).agg(F.sum("a").alias("a"), F.sum("r").alias("r")).withColumn("x", F.substring("g", 1, k))
        kinds = (F.count(F.when(F.col(c) > 0, 1)).alias(f"u{c}") for c in "ar")
        total = count.groupBy("x").agg(F.sum("a").alias("na"), F.sum("r").alias("nr"), *kinds)
        both = count.join(total, "x")
        if below is None:
            both = both.withColumns({f"q{c}": F.lit(1.0 / ALPHABET) for c in "ar"})
        else:
            both = both.withColumn("s", F.substring("g", 2, k)).join(below.withColumnsRenamed({"g": "s", "pa": "qa", "pr": "qr"}), "s")
        smooth = {f"p{c}": F.when(F.col(f"n{c}") > 0, (F.col(c) + F.col(f"u{c}") * F.col(f"q{c}")) / (F.col(f"n{c}") + F.col(f"u{c}"))).otherwise(F.col(f"q{c}")) for c in "ar"}
        below = both.withColumns(smooth).select("g", "pa", "pr")
    return below.select("g", (F.log("pa") - F.log("pr")).alias("w"))


def threshold(scores: DataFrame) -> float | None:
    """The score that separates allowed from blocked best, by the sum of both error rates; the least of equals. scores: score, verdict.
    At most 2 * LIMIT / BIN bins reach the driver. Without one of the two classes it is null."""
    b = F.floor(F.greatest(F.least("score", F.lit(LIMIT)), F.lit(-LIMIT)) / BIN).alias("b")
    bins = scores.where("verdict is not null").groupBy(b).agg(F.sum((F.col("verdict") == "allow").cast("long")).alias("a"), F.sum((F.col("verdict") == "block").cast("long")).alias("r")).orderBy("b").collect()
    na, nr = sum(x.a for x in bins), sum(x.r for x in bins)
    if not na or not nr:
        return None
    best, at, lost, kept = 2.0, 0.0, 0, nr
    for x in bins:
        if (error := lost / na + kept / nr) < best - 1e-12:
            best, at = error, x.b * BIN
        lost, kept = lost + x.a, kept - x.r
    return at


def filter_urls(pages: DataFrame, key: str = "page_id", url: str = "url", rules: list[tuple[str, str, str]] = RULES, order: int = ORDER) -> DataFrame:
    """(key, host, path, rule, verdict, score), one row per row of pages.

    The rule decides where one fits; elsewhere allow if the score reaches the calibrated threshold (that of all urls with a rule where the held ones
    lack a class, 0 where all do). A null or empty url has score 0, empty host
    and path. Repeated rows get equal rows. An empty table gives an empty table. Other columns of pages are not read.
    """
    h, p = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select(F.col(key).alias("k"), F.col(url).alias("url")).groupBy("k", "url").agg(F.count(F.lit(1)).alias("copies"))
    # short rows that become many: a fixed number of partitions, as adaptive execution would judge them by their size. Spark leaves out a
    # repartition by the keys that the rows are grouped by, so it goes by their hash
    rows = rows.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("k", "url"))
    named = rows.withColumns({"host": h, "path": p}).withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)).withColumn("verdict", F.col("fit.verdict"))
    held = F.pmod(F.xxhash64("url"), F.lit(HELD)) == 0
    # urls that are held out add no counts, but their grams are in the table, with what smoothing gives them
    table = small(materialize(model(named.withColumn("verdict", F.when(~F.coalesce(held, F.lit(False)), F.col("verdict"))), order), "model"), (ALPHABET + 1) ** (order + 1))
    # the gram rows of a url stay in its task until they are added up, so only one row a url is shuffled
    each = named.select("k", "url", F.explode(grams(F.col("url"), order)).alias("g")).join(table, "g").groupBy("k", "url").agg((F.sum(F.round("w", 9).cast("decimal(20,9)")) / F.count(F.lit(1))).cast("double").alias("score"))
    scored = materialize(named.join(each.withColumnsRenamed({"k": "k2", "url": "url2"}), F.col("k").eqNullSafe(F.col("k2")) & (F.col("url") == F.col("url2")), "left").withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 6)), "scores")
    found = [x for x in (threshold(scored.where(held)), threshold(scored)) if x is not None]
    least = found[0] if found else 0.0
    verdict = F.coalesce("verdict", F.when(F.col("score") >= least, "allow").otherwise("block"))
    out = scored.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(F.col("k").alias(key), "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "score")
