"""Packing (operator 3): best-fit decreasing with a segment tree over the remaining capacity of open windows.

Tokenising and cutting run where the text is; only piece lengths travel. Documents longer than a window are first cut into full
windows; all pieces are dealt by a hash into groups of about GROUP pieces, and each group packs its pieces, longest first, into the
tightest open window that still fits. Groups are independent, so the job is a map and one shuffle of short rows.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.llm.common import materialize, sliced

WINDOW, GROUP, END_ID = 2048, 8192, 1
#: Bytes of chunks and their ids that a worker keeps, and characters of text that it encodes at a time (a longer text comes alone).
CACHE, AT_ONCE = 60_000_000, 1_000_000
#: Texts that the tokenizer is given at a time: what it returns takes some hundred bytes a token until its ids are taken.
CALL = 64
#: How byte-level vocabularies write a blank.
BLANK = "\u0120"
SPACE = re.compile(r"\s")
#: A blank between two characters that are not white space, and blanks that are not such.
CUT, MORE = re.compile(r"(?<=\S) (?=\S)"), re.compile(r"\A | \Z| \s|[^\S ] ")
#: Equal pieces are dealt in runs of this many.
RUN = 1_000_000


class Encoder:
    """Ids of the tokenizer as little-endian 32-bit bytes.

    A byte-level vocabulary whose file splits texts by the usual pattern, without a normalizer, cuts before a single blank between two
    characters that are not white space, so what lies between such blanks is encoded once and kept. New chunks without white space are
    encoded many at a time: with a blank before each, their first tokens are just those that begin with the blank. Strings of added tokens in
    a text become those tokens, as the tokenizer does. If the file is of another kind, or an added token has white space, texts are encoded
    whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        form = json.loads(self.tokenizer.to_str())
        split = form.get("pre_tokenizer") or {}
        added = self.tokenizer.get_added_tokens_decoder().values()
        usual = form.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        self.cuts = usual and not any(re.search(r"\s", t.content) or t.lstrip or t.rstrip for t in added)
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.begins[[i for t, i in vocabulary.items() if t.startswith(BLANK)]] = True
        self.kept: dict[str, bytes] = {}  # chunks after a blank
        self.firsts: dict[str, bytes] = {}
        self.size = 0

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = (texts[i : i + CALL] for i in range(0, len(texts), CALL))
        return [np.array(e.ids, "<u4").tobytes() for part in parts for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        plain = [x for x in new if x and not SPACE.search(x)]
        runs = [plain[i : i + 256] for i in range(0, len(plain), 256)]
        for run, raw in zip(runs, self.encode(["".join(f" {x}" for x in run) for run in runs]), strict=True):
            at = 4 * np.flatnonzero(self.begins[np.frombuffer(raw, "<u4")])
            if len(at) == len(run):
                self.kept.update(zip(run, (raw[a:b] for a, b in zip(at, [*at[1:], len(raw)], strict=True)), strict=True))
        rest = [x for x in new if x not in self.kept]
        self.kept.update(zip(rest, self.encode([f" {x}" for x in rest]), strict=True))
        self.size += 160 * len(new) + 5 * sum(map(len, new))  # an id has four bytes and stands for a character at least

    def chunks(self, text: str) -> list[str]:
        """The first chunk, and all others without the blank before them."""
        return CUT.split(text) if MORE.search(text) else text.split(" ")

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.cuts:
            return self.encode(texts)
        if self.size > CACHE:
            self.kept, self.firsts, self.size = {}, {}, 0
        split = [self.chunks(t) for t in texts]
        new = set()
        for x in split:
            new.update(x[1:])
        self._learn(list(new.difference(self.kept)))
        begin = list({x[0] for x in split}.difference(self.firsts))
        self.firsts.update(zip(begin, self.encode(begin), strict=True))
        self.size += 160 * len(begin) + 5 * sum(map(len, begin))
        kept = self.kept.__getitem__
        return [b"".join([self.firsts[x[0]], *map(kept, x[1:])]) for x in split]


@cache
def encoder(path: str) -> Encoder:
    """One of a worker, which runs many tasks."""
    return Encoder(path)


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row a piece: key, start, length, ids_crc32, doc_tokens, and ids if asked for. Each document ends with end_id."""
    kind = docs.schema[key].dataType
    schema = f"{key} {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encode, end = encoder(tokenizer or public_tokenizers.path("byte_bpe_50k.json")), np.array([end_id], "<u4").tobytes()
        for batch in sliced(batches, text, AT_ONCE):
            rows: list[list] = [[] for _ in range(6)]
            for at, ids in enumerate(encode([t or "" for t in batch.column(1).to_pylist()])):
                ids += end
                for s in range(0, len(ids), 4 * window):
                    part = ids[s : s + 4 * window]
                    for col, x in zip(rows, (at, s // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4, np.frombuffer(part, "<i4") if with_ids else None), strict=True):
                        col.append(x)
            cols = [batch.column(0).take(pa.array(rows[0], pa.int64())), *(pa.array(x, pa.int64()) for x in rows[1:5])]
            cols += [pa.array(rows[5], pa.list_(pa.int32()))] * with_ids
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(key, text).mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece; longest first. Leaf r of the tree counts open windows with r left."""
    leaves = 1 << window.bit_length()
    tree, open_at = [0] * (2 * leaves), [[] for _ in range(window + 1)]
    seq, offset, made, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0, []

    def add(room: int, n: int) -> None:
        at = room + leaves
        while at:
            tree[at] += n
            at >>= 1

    for i in np.argsort(-lengths, kind="stable"):
        need = int(lengths[i])
        at = need + leaves
        if not tree[at]:  # up to the first right neighbour with an open window, then down its left side
            while at > 1 and (at & 1 or not tree[at + 1]):
                at >>= 1
            at = at + 1 if at > 1 else 0
            while 0 < at < leaves:
                at = 2 * at if tree[2 * at] else 2 * at + 1
        if at:
            room = at - leaves
            w = open_at[room].pop()
            add(room, -1)
        else:
            room, w, made = window, made, made + 1
            used.append(0)
        seq[i], offset[i] = w, used[w]
        used[w] += need
        if room > need:
            open_at[room - need].append(w)
            add(room - need, 1)
    return seq, offset


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, group: int = GROUP, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Rows of pieces() with sequence_id and offset; sequence_id is group number * 2**32 + number in the group.

    Pieces are dealt by a hash of what they are, so the result does not depend on how the table is split. Equal pieces of repeated rows are
    numbered and dealt apart. Null and empty texts are one piece with the end id alone. Pieces of a length are packed in the order of key and
    start. Null keys are kept. An empty table gives an empty table. Other columns of docs are not read, so their names cannot clash.
    """
    cut = materialize(pieces(docs.select(F.col(key).alias("k"), F.col(text).alias("text")), "k", "text", tokenizer, window, with_ids=with_ids), "pieces")
    groups = max(1, -(-cut.count() // group))
    runs = cut.groupBy(*cut.columns).agg(F.count(F.lit(1)).alias("m")).withColumn("r", F.explode(F.expr(f"sequence(0L, (m - 1) div {RUN})")))
    each = runs.withColumn("i", F.explode(F.expr(f"sequence(0L, least(m - r * {RUN}, {RUN}L) - 1)")))
    dealt = each.withColumn("g", F.pmod(F.xxhash64("k", "start", "ids_crc32", "r", "i"), F.lit(groups))).drop("m", "r", "i")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("k", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        seq, offset = best_fit(table.column("length").to_numpy(), window)
        place = pa.array((table.column("g")[0].as_py() << 32) + seq)
        return table.drop_columns(["g"]).append_column("sequence_id", place).append_column("offset", pa.array(offset))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    return dealt.groupBy("g").applyInArrow(run, schema).withColumnRenamed("k", key)
