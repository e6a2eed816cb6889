"""WARC archives of web pages: writing, reading back, and assembly of transactions.

Each page becomes a capture of three records: a request, a response (or a
revisit that names the response with the same payload), and metadata with the
page's number; request and metadata name the main record in WARC-Concurrent-To.
Archives are gzip files of whole records, written by Spark's own committed
writer into the shared folder.  The reader streams a gzip archive (of one member
or of one for each record) record by record by its Content-Length, whatever 1.x
version its first line names, so a payload that contains a record's first line
is harmless and memory holds one record.  Bytes that no record covers, such as
a record cut off or one without a length, come back as a row of type UNCOVERED
with these bytes as its payload (all but the bare letters MARK at the very end of
a file, which the line reader doesn't hand on).  Assembly joins the three kinds through the
concurrent-to identifiers and emits one nested row per capture.

Equal payloads are found by digest: the smallest page number of each digest
with more than one page is aggregated before the shuffle, and only the
(page, digest) pairs join it, so a digest that a third of all pages share is
never gathered in a task.

A null html is an empty payload; a null url is left out of the headers, and line
breaks in one are percent-encoded; a null page_id comes after all others; of
repeated rows (same page_id and payload) one is the response and the others
revisit it; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kreditflow.llm.common import materialize
from kreditflow.session import scratch_path

MARK = "WARC/1."
VERSION = MARK + "1\r\n"
UNCOVERED = "uncovered"
CRLF = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_REVISIT_BYTES = 100
CAPTURES_PER_FILE = 20_000
NO_ID = 2**63 - 1
DATE = "2000-01-01T00:00:00Z"
RECORD_FIELDS = ("warc_type", "record_id", "concurrent_to", "refers_to", "target_uri", "payload_digest")
HEADERS = dict(zip(RECORD_FIELDS, ("warc-type", "warc-record-id", "warc-concurrent-to", "warc-refers-to", "warc-target-uri", "warc-payload-digest"), strict=True))
RECORDS = ", ".join(f"{c} string" for c in RECORD_FIELDS) + ", head string, payload binary"


# ---------------------------------------------------------------- writing
def _urn(*parts: Column) -> Column:
    """A record's identifier, made of what identifies it, so that a repeated task writes the same."""
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(headers: list[tuple[str, Column | str]], block: Column) -> Column:
    lines = [F.lit(VERSION)]
    for name, value in headers:
        value = F.lit(value) if isinstance(value, str) else value
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit("")))
    lines += [F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block, F.lit(CRLF + CRLF)]
    return F.concat(*lines)


def captures(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Pages with payload, digest, the number of the copy among repeated rows, and the page that they revisit."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("k"),
        F.regexp_replace(F.regexp_replace(F.col("url").cast("string"), "\r", "%0D"), "\n", "%0A").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    narrow = rows.filter(F.octet_length("payload") >= min_bytes).select("k", "digest")
    shared = narrow.groupBy("digest").agg(F.min("k").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    shared = materialize(shared, "warc-shared")  # its own table: both sides of the join are plain exchanges, so hot digests split
    marked = narrow.join(shared, "digest").groupBy("k", "digest").agg(F.min("first").alias("first"))
    copy = F.row_number().over(Window.partitionBy("k", "digest").orderBy("url"))  # dealt out as the join is: pages move once
    joined = rows.join(marked, ["k", "digest"], "left").withColumn("copy", copy)
    main = (F.col("k") == F.col("first")) & (F.col("copy") == 1)
    return joined.withColumn("is_revisit", F.col("first").isNotNull() & ~main)


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Gzip WARC files under ``path``."""
    c = captures(pages, min_bytes)
    own = _urn(F.lit("main"), F.col("k"), F.col("digest"), F.col("copy"))
    target = _urn(F.lit("main"), F.col("first"), F.col("digest"), F.lit(1))
    revisit = F.col("is_revisit")
    status = F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: ")
    http = F.concat(status, F.octet_length("payload").cast("string"), F.lit(CRLF + CRLF))
    request = _record(
        [("WARC-Type", "request"), ("WARC-Record-ID", _urn(F.lit("request"), own)), ("WARC-Date", DATE), ("WARC-Target-URI", F.col("url")), ("WARC-Concurrent-To", own), ("Content-Type", "application/http; msgtype=request")],
        F.concat(F.lit("GET "), F.coalesce(F.col("url"), F.lit("/")), F.lit(" HTTP/1.1" + CRLF + CRLF)),
    )
    main = _record(
        [
            ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            ("WARC-Record-ID", own),
            ("WARC-Date", DATE),
            ("WARC-Target-URI", F.col("url")),
            ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
            ("WARC-Profile", F.when(revisit, REVISIT_PROFILE)),
            ("WARC-Refers-To", F.when(revisit, target)),
            ("Content-Type", "application/http; msgtype=response"),
        ],
        F.concat(http, F.when(revisit, "").otherwise(F.col("payload"))),
    )
    metadata = _record(
        [("WARC-Type", "metadata"), ("WARC-Record-ID", _urn(F.lit("metadata"), own)), ("WARC-Date", DATE), ("WARC-Target-URI", F.col("url")), ("WARC-Concurrent-To", own), ("Content-Type", "application/warc-fields")],
        F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(CRLF)), F.lit("")),
    )
    # the writer ends each row by a line break, the last of the two that end a record
    text = F.regexp_replace(F.concat(request, main, metadata), "\r\n$(?!\n)", "")
    (c.select(text.alias("value")).write.option("lineSep", CRLF).option("compression", "gzip").option("maxRecordsPerFile", CAPTURES_PER_FILE).text(path))


# ---------------------------------------------------------------- reading
def _parse_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments between version marks, in order of a file; a record ends where its Content-Length says."""
    mark = MARK.encode()
    at, held, need = None, b"", 0
    rows: list[tuple] = []

    def head_of(record: bytes) -> tuple[dict[str, str], int]:
        """Header fields and the place of the block; 0 if it isn't complete yet, -1 if this is no record."""
        if not re.match(rb"\d+\r\n", record):
            return {}, -1
        end = record.find(b"\r\n\r\n")
        fields = {}
        for line in record[:end].split(b"\r\n")[1:] if end >= 0 else ():
            name, _, value = line.partition(b":")
            fields[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
        if end >= 0 and not fields.get("content-length", "").isdecimal():
            return fields, -1
        return fields, end + 4 if end >= 0 else 0

    def parse(record: bytes, fields: dict[str, str], start: int, end: int) -> None:
        block = record[start:end]
        head, payload = block, None
        if fields.get("content-type", "").startswith("application/http"):
            head, _, payload = block.partition(b"\r\n\r\n")
            if fields.get("warc-type") != "response":
                payload = None
        rows.append((*[fields.get(HEADERS[c]) for c in RECORD_FIELDS], head.decode("utf-8", "replace"), payload))
        report(record[end:])

    def report(left: bytes) -> None:
        if left.strip(b"\r\n"):
            rows.append((UNCOVERED, *[None] * len(RECORD_FIELDS), left))

    def out() -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        kinds = [pa.string()] * 7 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [*RECORD_FIELDS, "head", "payload"])

    size, fields, start = 0, {}, 0
    for b in batches:
        for path, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if path != at:
                report(held)
                at, held, need = path, b"", 0
                report(part)  # what stands before the first mark
                continue
            held = held + mark + part if held else part
            if not need:
                fields, start = head_of(held)
                need = start + int(fields["content-length"]) if start > 0 else 0
            if start < 0:
                report(mark + held)
            elif not need or len(held) < need:
                continue
            else:
                parse(held, fields, start, need)
            size += len(held)
            held, need = b"", 0
            if size >= 8 << 20 and rows:
                yield out()
                rows.clear()
                size = 0
    report(held)
    if rows:
        yield out()


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the gzip archives under ``path``."""
    lines = spark.read.option("lineSep", MARK).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value")).mapInArrow(_parse_records, RECORDS)


def assemble(records: DataFrame, fields: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per capture: structs ``main``, ``request`` and ``metadata`` (null where a record is missing).

    ``fields`` names the columns that each struct carries through the joins (all by default).
    ``records`` should be a stored table: it is read once for each kind.
    """

    def kind(types: list[str], key: str, name: str) -> DataFrame:
        own = F.struct(*[F.col(c) for c in (fields or {}).get(name, records.columns)])
        return records.filter(F.col("warc_type").isin(*types)).select(F.col(key).alias("key"), own.alias(name))

    main = kind(["response", "revisit"], "record_id", "main")
    asked, about = kind(["request"], "concurrent_to", "request"), kind(["metadata"], "concurrent_to", "metadata")
    return main.join(asked, "key", "left").join(about, "key", "left").drop("key")


def op4_warc(spark, sf_dir: str) -> DataFrame:
    """Write all ``pages`` to archives, read them back, and report each capture's payload and record type."""
    path = scratch_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet"), path)
    records = read_archives(spark, path)
    # what the report needs of each record; payloads and heads are not kept twice
    records = records.select(
        "warc_type",
        "record_id",
        "concurrent_to",
        "refers_to",
        "target_uri",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.unhex(F.sha2("payload", 256)).alias("sha256"),
        F.when(F.col("warc_type") == "metadata", F.regexp_extract("head", r"page-id: (-?\d+)", 1)).try_cast("long").alias("page_id"),
    )
    fields = {"main": ["record_id", "warc_type", "refers_to", "payload_bytes", "sha256"], "request": ["target_uri"], "metadata": ["page_id"]}
    rows = assemble(materialize(records, "warc-records"), fields).select(
        F.col("metadata.page_id").alias("page_id"),
        F.col("main.record_id").alias("record_id"),
        F.col("main.warc_type").alias("record_type"),
        F.col("main.refers_to").alias("refers_id"),
        F.col("main.payload_bytes").alias("payload_bytes"),
        F.col("main.sha256").alias("sha256"),
        F.col("request.target_uri").alias("target_uri"),
    )
    rows = materialize(rows, "warc-captures")
    responses = rows.filter("record_type = 'response'")
    named = responses.select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"), "payload_bytes", "sha256")
    revisits = rows.filter("record_type = 'revisit'").select("page_id", "refers_id", "record_type", "target_uri").join(named, "refers_id", "left")
    digest = F.lower(F.hex("sha256")).alias("payload_digest")
    shape = ["page_id", "payload_bytes", digest, "record_type", "refers_to", "target_uri"]
    return responses.withColumn("refers_to", F.lit(None).cast("long")).select(*shape).unionByName(revisits.select(*shape))


#: Without target_uri no SQL is needed for the archive itself: the round trip must give the table back.
SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, url, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_page FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first_page <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first_page <> page_id THEN first_page END AS refers_to,
       url AS target_uri
FROM f
"""
