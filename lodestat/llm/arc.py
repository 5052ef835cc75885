"""WARC (operator 4): legacy ARC archives become WARC records.

An ARC file opens with a version block, whose first line of content gives the version; the version decides the fields of every header
line (version 1: five fields, version 2: ten). A record's bytes are taken by its declared length alone. Each record gets the WARC
identifier, timestamp, type and digests that its ARC fields imply. Archives are Spark rows of bytes, as the binaryFile source gives
them, and WARC files are written and read by Spark's sources, so any store that Spark reaches will do.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.llm.common import materialize, new_path, sliced, small

#: The fields of header lines by ARC version.
FIELDS = {
    "1": ["url", "ip", "date", "type", "length"],
    "2": ["url", "ip", "date", "type", "status", "checksum", "location", "offset", "filename", "length"],
}
ID_FIELD, REF_FIELD = "X-Row-Id", "X-Refers-To-Row-Id"
RECORDS_PER_FILE, FILE_BYTES = 2000, 512 << 20
RECORD = "arc_version string, id string, url string, timestamp string, mime string, status int, head binary, payload binary, payload_bytes long, payload_digest string, block_digest string"


def sha1_32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def write_arc(records: list[tuple[str, str, bytes]], version: str, date: str = "20000101000000") -> bytes:
    """An ARC file of (url, mime, network document)."""
    names = {"1": "URL IP-address Archive-date Content-type Archive-length", "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
    intro = f"{version} 0 lodestat\n{names[version]}\n\n".encode()
    more = " 200 - - 0 pages.arc" if version == "2" else ""
    out = [f"filedesc://pages.arc 0.0.0.0 {date} text/plain{more} {len(intro)}\n".encode() + intro]
    out += [f"{url} 0.0.0.0 {date} {mime}{more} {len(doc)}\n".encode("utf-8", "surrogatepass") + doc + b"\n" for url, mime, doc in records]
    return b"".join(out)


def parse_arc(data: bytes) -> Iterator[tuple[str, dict[str, str], bytes]]:
    """(version, fields, network document) of each record. A header line whose field count or length is wrong raises ValueError with its place."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at, fields, version = 0, FIELDS["1"], ""
    while at < len(data):
        if data[at] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].decode("utf-8", "surrogateescape").rstrip("\r")
        values = line.rsplit(" ", (10 if not version and line.count(" ") >= 9 else len(fields)) - 1)
        length = values[-1]
        if end < 0 or not length.isdigit() or end + 1 + int(length) > len(data) or version and len(values) != len(fields):
            raise ValueError(f"bad ARC header line at byte {at}: {line[:80]!r}")
        block = data[end + 1 : end + 1 + int(length)]
        at = end + 1 + int(length)
        if not version:
            if not line.startswith("filedesc://"):
                raise ValueError("an ARC file starts with a filedesc record")
            version = block.split(b" ", 1)[0].decode()
            if version not in FIELDS:
                raise ValueError(f"ARC version {version!r} is unknown")
            fields = FIELDS[version]
        else:
            yield version, dict(zip(fields, values, strict=True)), block


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head, with its blank line, and entity body; a block without a head is all body."""
    if block.startswith(b"HTTP/") and (cut := block.find(b"\r\n\r\n")) >= 0:
        return block[: cut + 4], block[cut + 4 :]
    return b"", block


def http_field(head: bytes, name: str) -> str | None:
    for line in head.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        if key.lower() == name.lower().encode():
            return value.strip().decode("utf-8", "replace")
    return None


def arc_archives(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", chunk: int = 4_000_000) -> DataFrame:
    """(content): ARC files, of versions 1 and 2 by turns, each of some pages; a file ends at about `chunk` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, b in enumerate(sliced(batches, "html", chunk)):
            records = []
            for k, u, t in zip(*(b.column(c).to_pylist() for c in ("k", "url", "html")), strict=True):
                own = f"{ID_FIELD}: {k}\r\n" if k is not None else ""
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}\r\n".encode()
                place = "".join(c if c > " " else f"%{ord(c):02X}" for c in u or "") or "unknown:"
                records.append((place, "text/html", head + (t or "").encode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays([pa.array([write_arc(records, "12"[i % 2])], pa.binary())], names=["content"])

    named = pages.select(F.col(key).cast("string").alias("k"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    return named.mapInArrow(run, "content binary")


def arc_records(archives: DataFrame, content: str = "content") -> DataFrame:
    """One row a record of ARC archives; id is the field X-Row-Id of its HTTP head, if any."""
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [pa.string()] * 5 + [pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                rows: list[tuple] = []
                for version, f, block in parse_arc(data.as_py() or b""):
                    head, body = split_http(block)
                    when = datetime.strptime(f["date"][:14].ljust(14, "0"), "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc)
                    status = int(head[9:12]) if head[9:12].isdigit() else None
                    rows.append((version, http_field(head, ID_FIELD), f["url"], when.strftime("%Y-%m-%dT%H:%M:%SZ"), f["type"], status, head, body, len(body), sha1_32(body), sha1_32(block)))
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return archives.select(content).mapInArrow(run, RECORD)


def warc_records(records: DataFrame, min_bytes: int = 0, id_type: str = "long") -> DataFrame:
    """Adds record_id, record_type and refers_to (id of the response). Of records with equal payloads of min_bytes or more, that with the least
    id is the response; ids are compared as id_type. Without an id, a record is a response."""
    named = records.withColumn("_id", F.col("id").cast(id_type))
    # only digests that come twice are joined, as short rows; while they are few, no payload is shuffled
    short = materialize(named.select("_id", "payload_digest", "payload_bytes").where((F.col("payload_bytes") >= min_bytes) & F.col("_id").isNotNull()), "short")
    first = short.groupBy("payload_digest").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    again = short.join(first, "payload_digest").where(F.col("_id") != F.col("_first")).select(F.col("_id").alias("_again"), F.col("payload_digest").alias("_d"), "_first").distinct()
    # by id, not by digest: beyond the broadcast, records with one payload would meet in a task
    again = small(materialize(again, "repeated"))
    out = named.join(again, (F.col("_id") == F.col("_again")) & (F.col("payload_digest") == F.col("_d")), "left")
    again = F.col("_first").isNotNull()
    uuid = lambda c: F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(c), "^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "$1-$2-3$3-8$4-$5"), F.lit(">"))
    name = lambda i: uuid(F.concat_ws(" ", i.cast("string"), "payload_digest").cast("binary"))
    refers = F.when(again, F.col("_first"))
    return out.select(*records.columns, name(F.col("_id")).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), refers.alias("refers_to"), F.when(again, name(F.col("_first"))).alias("refers_to_record"))


def write_warc(records: DataFrame, path: str, per_file: int = RECORDS_PER_FILE, file_bytes: int = FILE_BYTES, bound: int | None = None) -> None:
    """Writes warc_records() as gzipped WARC files of at most per_file records and about file_bytes of payload; a larger record has a file of
    its own. Records are written by classes of size, of which most tables have one; bound is the
    largest payload, if it is known. A revisit holds the HTTP head alone and names its response; payload digest and length are
    those of the full payload. The files are bytes: no record is decoded on the way."""
    again, r = F.col("record_type") == "revisit", "\r\n"
    body = F.when(again, F.col("head")).otherwise(F.concat("head", "payload"))
    field = lambda n, v: F.coalesce(F.concat(F.lit(n + ": "), v.cast("string"), F.lit(r)), F.lit(""))
    top = F.concat(
        F.lit("WARC/1.1" + r),
        field("WARC-Type", F.col("record_type")),
        field("WARC-Record-ID", F.col("record_id")),
        field("WARC-Date", F.col("timestamp")),
        field("WARC-Target-URI", F.col("url")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        field("WARC-Block-Digest", F.when(~again, F.concat(F.lit("sha1:"), "block_digest"))),
        field("WARC-Profile", F.when(again, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        field("WARC-Refers-To", F.col("refers_to_record")),
        field(REF_FIELD, F.col("refers_to")),
        field("X-Payload-Length", F.col("payload_bytes")),
        F.lit("Content-Type: application/http; msgtype=response" + r),
        field("Content-Length", F.length("b")),
        F.lit(r),
    )
    whole = records.withColumn("b", body).select("payload_bytes", F.concat(top.cast("binary"), F.col("b")).cast("string").alias("value"))
    steps = [per_file]
    while steps[-1] > 1:
        steps.append(max(1, steps[-1] // 16))
    limits = [file_bytes // k for k in steps[:-1]]  # a class's largest payload; the last has no limit
    size = sum((F.when(F.col("payload_bytes") > x, 1).otherwise(0) for x in limits[1:]), F.when(F.col("payload_bytes") > limits[0], 1).otherwise(0)) if limits else F.lit(0)
    classes = {0} if bound is not None and limits and bound <= limits[0] else set(range(len(steps)))
    for i in sorted(classes):
        own = whole if classes == {0} else whole.where(size == i)
        own.select("value").write.mode("append").option("lineSep", r + r).option("compression", "gzip").option("maxRecordsPerFile", steps[i]).text(path)


def parse_warc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record, by declared lengths."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8", "surrogateescape").partition(":")
            head[k.strip().lower()] = v.strip()
        block = stream.read(int(head["content-length"]))
        if len(block) != int(head["content-length"]):
            raise ValueError(f"record {head.get('warc-record-id')} is cut off")
        yield head, block


def read_warc(df: DataFrame, content: str = "content") -> DataFrame:
    """Records of WARC files: id, url, record_type, record_id, payload (null for a revisit), payload_bytes, payload_digest, refers_to.
    A response's digest is computed from its payload, and one that differs from the declared digest raises an error."""
    schema = "id string, url string, record_type string, record_id string, payload binary, payload_bytes long, payload_digest string, refers_to string"
    kinds = [pa.string()] * 4 + [pa.binary(), pa.int64(), pa.string(), pa.string()]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        done = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for b in batches:
            for data in b.column(0):
                raw = io.BytesIO(data.as_py() or b"")
                for h, block in parse_warc(io.BufferedReader(gzip.GzipFile(fileobj=raw)) if raw.getbuffer()[:2] == b"\x1f\x8b" else raw):
                    head, body = split_http(block)
                    declared, kind = h.get("warc-payload-digest", "").removeprefix("sha1:"), h["warc-type"]
                    if kind != "revisit" and declared != sha1_32(body):
                        raise ValueError(f"payload of {h.get('warc-record-id')} differs from its digest")
                    n = int(h.get("x-payload-length", 0)) if kind == "revisit" else len(body)
                    rows.append((http_field(head, ID_FIELD), h.get("warc-target-uri"), kind, h.get("warc-record-id"), None if kind == "revisit" else body, n, declared, h.get(REF_FIELD.lower())))
                    if len(rows) == 500:
                        yield done()
                        rows.clear()
        if rows:
            yield done()

    return df.select(content).mapInArrow(run, schema)


def convert(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """Pages through ARC archives into WARC files and back: (key, payload_bytes, payload_digest, record_type, refers_to).

    Null html is an empty payload, which counts as a payload of 0 bytes. A null url becomes "unknown:". Rows that repeat a key and payload are
    responses with the same least key. A page without a key is a response. An empty table gives an empty table. Other columns are not read.
    A WARC file is read as one value; write_warc() keeps it far below 2 GB, but for a single larger page.
    """
    spark, kind = pages.sparkSession, pages.schema[key].dataType.simpleString()
    path = new_path(spark, "warc")
    records = arc_records(arc_archives(pages, key, url, html))
    largest = pages.agg(F.max(F.octet_length(html))).first()[0] or 0
    write_warc(warc_records(records, min_bytes, kind), path, per_file, bound=largest)
    files = spark.read.format("binaryFile").load(path)
    return read_warc(files).select(F.col("id").cast(kind).alias(key), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, strlen(h) AS n, sha1(h) AS x, min(page_id) OVER (PARTITION BY sha1(h)) AS f FROM p),
bits AS (SELECT *, [CAST(strpos('0123456789abcdef', x[2 * i + 1 : 2 * i + 1]) - 1 AS INTEGER) * 16 + CAST(strpos('0123456789abcdef', x[2 * i + 2 : 2 * i + 2]) - 1 AS INTEGER) FOR i IN range(0, 20)] AS b FROM s)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((b[(5 * j) // 8 + 1] * 256 + coalesce(b[(5 * j) // 8 + 2], 0)) >> (11 - (5 * j) % 8)) & 31)::INTEGER, 1) FOR j IN range(0, 32)], '') AS payload_digest,
       CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = f THEN NULL ELSE f END AS refers_to
FROM bits
"""
