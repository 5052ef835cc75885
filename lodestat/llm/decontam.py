"""Benchmark decontamination (operator 5, native): a distributed positional inverted index.

One pass over the corpus stores a posting (row, position, term) for every word that some test item has; nothing else reads words again.
For each window of N test words the lists of its RAREST rarest terms are intersected first, each moved back by the term's offset in
the item: what all of them share is an alignment (row, item, diagonal). Only along alignments are the lists of the item's other terms
intersected, and runs of N matches or more are phrase matches. The same postings give proximity matches.

A row is named by its key and the hash of its text. The test side (terms, anchors, item words) is broadcast in blocks of at most
BLOCK rows, so a larger benchmark costs more passes over the postings and not more memory.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestat.llm.common import LOWER, UPPER, materialize, small

N, PERCENT, RAREST = 13, 5, 3
#: Words are runs of what is not one of these ASCII characters; A-Z counts as a-z.
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Rows of the test side that are broadcast at a time.
BLOCK = 500_000


def pieces(text: Column) -> Column:
    """The words of a text as they are written; only the first and the last piece may be empty."""
    return F.split(F.coalesce(text, F.lit("")), BREAKS)


def lowered(word: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII words take the fast function."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(pieces(text), "")).cast("long")


def row_name(key: str, text: str) -> list[Column]:
    """Names a row by its key and the hash of its text, so null keys and keys that repeat with other texts stay apart."""
    return [F.col(key).alias("k"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("t")]


def same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["k"].eqNullSafe(b["k"]) & (a["t"] == b["t"])


def in_blocks(big: DataFrame, table: DataFrame, on: str, rows: int = BLOCK) -> DataFrame:
    """big joined with a materialised table, which is broadcast in blocks of about `rows` rows, dealt by a hash of the join column. Rows that share
    a value of it stay together, so a block is larger only where one value alone has more rows."""
    n = -(-table.count() // rows)
    if n <= 1:
        return big.join(F.broadcast(table), on)
    return reduce(DataFrame.unionByName, (big.join(F.broadcast(table.where(F.pmod(F.xxhash64(on), F.lit(n)) == i)), on) for i in range(n)))


@dataclass
class Index:
    """tests (i, item, n, p, id): words of the test items, i for each distinct item and text; postings (k, t, q, id); counts (id, c)."""

    tests: DataFrame
    postings: DataFrame
    counts: DataFrame


def build_index(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> Index:
    """Postings of all words that the test items have. Items that repeat a key with the same words count once."""
    lower_all = F.transform(F.array_remove(pieces(F.col(item_text)), ""), lowered)
    each = items.select(F.col(item_key).alias("item"), lower_all.alias("w")).where(F.size("w") > 0).distinct()
    each = materialize(each.withColumn("i", F.monotonically_increasing_id()), "items").select("i", "item", F.size("w").alias("n"), F.posexplode("w").alias("p", "word"))
    terms = materialize(each.select("word").distinct().withColumn("id", F.monotonically_increasing_id()), "terms")
    tests = materialize(each.join(terms, "word").select("i", "item", "n", "p", "id"), "tests")
    # named first: what stands beside a generator in one select is computed again for every word
    named = docs.select(*row_name(key, text), F.col(text).alias("text"))
    found = named.select("k", "t", F.posexplode(pieces(F.col("text"))).alias("q", "w")).select("k", "t", "q", lowered(F.col("w")).alias("word"))
    postings = materialize(in_blocks(found, terms, "word").select("k", "t", "q", "id"), "postings")
    return Index(tests, postings, materialize(postings.groupBy("id").agg(F.count(F.lit(1)).alias("c")), "counts"))


def anchors(index: Index, n: int = N, rarest: int = RAREST) -> DataFrame:
    """(id, i, g, p, need): the `rarest` rarest terms of each window, the first of equals. Windows of an item with the same terms at the same
    places are one group g; need is their number. Windows with a term that the corpus lacks occur nowhere and are left out."""
    known = index.tests.join(index.counts, "id", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    ahead = Window.partitionBy("i").orderBy("p").rowsBetween(0, n - 1)
    window = known.withColumn("a", F.collect_list(F.struct("c", "p", "id")).over(ahead)).where(F.col("p") <= F.greatest(F.col("n") - n, F.lit(0)))
    best = window.select("i", "p", F.slice(F.array_sort("a"), 1, rarest).alias("a")).where("a[0].c > 0")
    groups = best.groupBy("i", "a").agg(F.min("p").alias("g"))
    return groups.select("i", "g", F.size("a").alias("need"), F.explode("a").alias("x")).select("x.id", "i", "g", "x.p", "need")


def alignments(index: Index, n: int = N, rarest: int = RAREST) -> DataFrame:
    """(k, t, i, d): word p of item i would be word d + p of the row, and the rarest terms of a window are there. A row's postings lie together,
    so most of the counting is done before anything is shuffled."""
    at = in_blocks(index.postings, materialize(anchors(index, n, rarest), "anchors"), "id").select("k", "t", "i", "g", "need", (F.col("q") - F.col("p")).alias("d"))
    all_there = at.groupBy("k", "t", "i", "g", "need", "d").agg(F.count(F.lit(1)).alias("c"))
    return all_there.where("c >= need").select("k", "t", "i", "d").distinct()


def phrase_matches(index: Index, n: int = N, rarest: int = RAREST) -> DataFrame:
    """(k, t, item, q): words q of a row inside an occurrence of a window of an item. A copy of a row has the same name and the same matches."""
    aligned = materialize(alignments(index, n, rarest), "aligned")
    words = index.tests.select("i", "item", "p", "id", F.least("n", F.lit(n)).alias("m"))
    wanted = in_blocks(aligned, words, "i").withColumn("q", F.col("d") + F.col("p")).where("q >= 0")
    rows = small(materialize(aligned.select("k", "t").distinct(), "rows"))
    there = index.postings.join(rows, same_row(index.postings, rows), "left_semi")
    match = (wanted["q"] == there["q"]) & (wanted["id"] == there["id"]) & same_row(wanted, there)
    hit = wanted.join(there, match, "left_semi")
    run = F.col("p") - F.row_number().over(Window.partitionBy("k", "t", "i", "d").orderBy("p"))
    runs = hit.withColumn("run", run).groupBy("k", "t", "i", "item", "d", "m", "run").agg(F.min("q").alias("lo"), F.max("q").alias("hi"))
    return runs.where("hi - lo + 1 >= m").select("k", "t", "item", F.explode(F.sequence("lo", "hi")).alias("q"))


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256 and contaminated (n_hit > 0 and n_hit at least percent % of n_words).

    Null texts have no words. Items without words match nothing; an item shorter than n words is one window. Repeated rows get equal
    results. Null keys are kept, and rows with a null key and other texts are judged apart. Empty tables give empty or clean results.
    Columns of docs with the added names are replaced; others pass through, whatever their names.
    """
    added = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    hits = materialize(phrase_matches(build_index(docs, items, key, text, item_key, item_text), n).distinct(), "hits")
    count = hits.select("k", "t", "q").distinct().groupBy("k", "t").agg(F.count(F.lit(1)).alias("hit"))
    names = hits.groupBy("k", "t").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("names"))
    verdict = small(materialize(count.join(names.withColumnsRenamed({"k": "k2", "t": "t2"}), F.col("k").eqNullSafe(F.col("k2")) & (F.col("t") == F.col("t2"))).select("k", "t", "hit", "names"), "verdicts"))
    passed = docs.drop(*added)
    own = docs.select(F.struct(*(passed[c] for c in passed.columns)).alias("row"), *row_name(key, text), n_words(F.col(text)).alias("n"))
    out = own.join(verdict, same_row(own, verdict), "left").select("row", "n", F.coalesce("hit", F.lit(0)).cast("long").alias("hit"), "names")
    return out.select(
        "row.*",
        F.col("n").alias("n_words"),
        F.col("hit").alias("n_hit"),
        F.coalesce(F.size("names"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("names", ","), F.lit("")), 256).alias("items_sha256"),
        ((F.col("hit") > 0) & (F.lit(100) * F.col("hit") >= percent * F.col("n"))).alias("contaminated"),
    )


def proximity_matches(index: Index, rarest: int = 4, span: int = 20) -> DataFrame:
    """(k, t, item, q): places where the `rarest` rarest distinct terms of an item (all, if it has fewer) lie within span words, in any order; q is
    the first word. Terms that the corpus lacks count as rarest, so such items match nowhere."""
    terms = index.tests.select("i", "item", "id").distinct().join(index.counts, "id", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    ranked = terms.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy("c", "id"))).where(F.col("r") <= rarest)
    chosen = materialize(ranked.withColumn("need", F.count(F.lit(1)).over(Window.partitionBy("i"))).select("i", "item", "id", "need"), "chosen")
    at = in_blocks(index.postings, chosen, "id")
    # rows that lack one of the terms go before any sorting
    full = at.groupBy("k", "t", "i", "need").agg(F.count_distinct("id").alias("c")).where("c = need").select("k", "t", "i")
    full = small(materialize(full, "full"))
    rows = at.join(full, same_row(at, full) & (at["i"] == full["i"]), "left_semi").distinct()
    near = Window.partitionBy("k", "t", "i").orderBy("q").rangeBetween(0, span - 1)
    seen = rows.withColumn("got", F.size(F.collect_set("id").over(near)))
    return seen.where("got = need").select("k", "t", "item", "q").distinct()


ORACLE = r"""
WITH d AS (SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 13) AS m, array_to_string(w[s : s + least(len(w), 13) - 1], ' ') AS phrase
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, s, m, array_to_string(w[s : s + m - 1], ' ') AS phrase FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, sizes WHERE len(w) >= m)),
h AS (SELECT doc_id, s, dw.m, item FROM dw JOIN bw ON dw.m = bw.m AND dw.phrase = bw.phrase),
hits AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS q FROM h) GROUP BY doc_id),
names AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN names USING (doc_id)
"""
