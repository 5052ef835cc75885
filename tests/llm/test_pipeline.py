"""The pipeline: its rows against brute force of its stages, odd and clashing tables, empty tables."""

import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("lodestat.llm")
p = pytest.importorskip("corpus_pipeline")

from lodestat.llm import quality_rules  # noqa: E402
from test_llm import WORDS, classes_by_force, contamination_by_force, rules_by_force, text_of  # noqa: E402

#: Names that the operators add or use.
CLASHES = ["score", "kept", "n_words", "n_hit", "n_items", "n_removed", "base_failed", "contaminated", "items_sha256", "class_id", "k", "t", "row", "names", "hit", "copies", "_kept_1"]


def write(spark, path, docs, bench, labels):
    docs.write.parquet(f"{path}/documents.parquet")
    bench.write.parquet(f"{path}/benchmark.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return str(path)


def kept_by_force(texts, width=35):
    words = [WORDS.findall(t) for t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    gone = [{j for i in range(len(w) - width + 1) if seen[tuple(w[i : i + width])] > 1 for j in range(i, i + width)} for w in words]
    return [[x for i, x in enumerate(w) if i not in g] for w, g in zip(words, gone, strict=True)]


def bench_of(spark):
    return spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog while nobody ever looks at it again"), (2, None)], "item_id long, text string")


def test_rows_equal_brute_force(spark, data, tmp_path):
    """Every stage's rows follow from those of the one before; the verdict of the trained rule is taken from the operator itself."""
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = np.random.default_rng(5)
    base = [text_of(rng, int(n), 400) for n in rng.integers(60, 200, 30)]
    shared = text_of(rng, 45, 5000)
    item = "the quick brown fox jumps over the lazy dog while nobody ever looks at it again"
    texts = base + [base[3], base[4] + " tail", f"{base[5]} {shared}", f"{shared} {base[6]} {shared}", *(f"{item} {text_of(rng, 60, 400)}" for _ in range(6)), "short text", None, ""]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(len(texts) - 3)], "doc_id long, quality int, toxic int")
    path = write(spark, tmp_path, docs, bench_of(spark), labels)
    judged = quality_rules.quality_rules(docs, quality_rules.trusted_rows(labels), rejected=quality_rules.rejected_rows(labels)).collect()
    assert all(not r.kept for r in judged if rules_by_force(r.text)[-1])
    left = {r.doc_id: r.text for r in judged if r.kept}
    assert {len(texts) - 3, len(texts) - 2, len(texts) - 1}.isdisjoint(left)

    ids = sorted(left)
    classes = classes_by_force([left[i] for i in ids])
    first = {}
    for i, c in zip(ids, classes, strict=True):
        first.setdefault(c, i)
    left = {i: left[i] for i in first.values()}
    assert len(left) < len(ids)

    ids = sorted(left)
    cut = dict(zip(ids, kept_by_force([left[i] for i in ids]), strict=True))
    assert sum(cut[i] != left[i].split() for i in ids) >= 2
    left = {i: (left[i] if cut[i] == left[i].split() else " ".join(cut[i])) for i in ids if cut[i]}

    ids = sorted(left)
    dirty = contamination_by_force([left[i] for i in ids], [(1, item)])
    left = {i: left[i] for i, r in zip(ids, dirty, strict=True) if not r[4]}
    assert len(left) < len(ids)

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in left.items()}
    rows = p.run(spark, path).toPandas()
    assert set(rows.doc_id) == set(want)
    for i, own in rows.sort_values("start").groupby("doc_id"):
        ids_ = want[i]
        assert list(own.start) == list(np.cumsum([0, *own.length[:-1]])) and own.length.sum() == len(ids_) == own.doc_tokens.iloc[0]
        assert all(zlib.crc32(ids_[s : s + n].tobytes()) == c for s, n, c in zip(own.start, own.length, own.ids_crc32, strict=True))
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert list(own.offset) == list(np.cumsum([0, *own.length[:-1]])) and own.length.sum() <= 2048


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    rng = np.random.default_rng(12)
    long = text_of(rng, 6000)
    rows = [(None, text_of(rng, 90)), (None, None), (1, long), (1, long), (1, text_of(rng, 70)), (2, None), (3, ""), (4, "  "), (5, text_of(rng, 80)), (5, text_of(rng, 80)), (6, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *(f"'{c}' as {c}" for c in CLASHES))
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 0), (6, 1, 0), (None, 1, None)], "doc_id long, quality int, toxic int")
    return write(spark, tmp_path_factory.mktemp("odd"), docs, bench_of(spark), labels)


def expected(spark, odd):
    """(doc_id, words) of what the quality rules keep, each text once, under its least doc_id."""
    docs, labels = p.read(spark, odd, "documents").select("doc_id", "text"), p.read(spark, odd, "labels")
    kept = quality_rules.quality_rules(docs, quality_rules.trusted_rows(labels), rejected=quality_rules.rejected_rows(labels)).where("kept").collect()
    texts = {r.text for r in kept}
    assert len(texts) >= 3
    return {(min((r.doc_id for r in kept if r.text == t and r.doc_id is not None), default=None), len(t.split())) for t in texts}


def test_columns_keep_their_values_in_every_stage(spark, odd):
    docs = p.read(spark, odd, "documents")
    columns = docs.columns
    for name, stage in p.STAGES[:-1]:
        docs = p.materialize(stage(spark, docs, odd))
        assert docs.columns == columns, name
        rows = docs.collect()
        assert rows and all(r[c] == c for r in rows for c in CLASHES), name
    assert {(r.doc_id, len(r.text.split())) for r in rows} == expected(spark, odd)


def test_odd_and_empty_tables(spark, odd, tmp_path):
    assert {r.doc_id for r in p.run(spark, odd).collect()} == {k for k, _ in expected(spark, odd)}
    empty = write(spark, tmp_path, p.read(spark, odd, "documents").limit(0), bench_of(spark), p.read(spark, odd, "labels"))
    assert p.run(spark, empty).count() == 0
