"""WARC archives: writing, reading and the assembly of transactions.

Records are written by Spark's own text writer, whose line separator is the two line ends that close a
record; its commit protocol makes the archives safe against lost executors.  Every file is gzip.
Archives are read with the ``binaryFile`` source and parsed by Content-Length, a record at a time, so
payloads may hold any bytes.  Single and per-record gzip members, and plain files, are understood.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow, store

CRLF = "\r\n"
#: Payloads under this many bytes are never revisited.
LEAST_REVISIT = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: A file holds FILE_ROWS pages of up to LARGE bytes, or as many larger ones as fit FILE_BYTES (one at least).
FILE_ROWS, LARGE, FILE_BYTES = 1_000, 1 << 18, 1 << 28
#: Bytes of compressed input that are inflated at once.
CHUNK = 1 << 20
#: Records of one transaction that one nested row holds at most; further ones go to rows with part 1, 2 and so on.
PART_ROWS = 10_000

RECORD_FIELDS = (
    "record_id string, record_type string, concurrent_to array<string>, refers_to string, target_uri string, date string, "
    "claimed_digest string, payload_bytes bigint, payload_digest string, http_header string, payload binary, file string, offset bigint"
)


def _header(kind: str, own: Column, uri: Column, length: Column, *more: Column) -> Column:
    lines = [
        F.lit(f"WARC/1.1{CRLF}WARC-Type: {kind}{CRLF}WARC-Record-ID: <"), own, F.lit(f">{CRLF}WARC-Date: {DATE}{CRLF}WARC-Target-URI: "), uri, *more,
        F.lit(f"{CRLF}Content-Length: "), length.cast("string"), F.lit(CRLF * 2),
    ]
    return F.concat(*lines)


def write_pages(pages: DataFrame, path: str) -> None:
    """Write three records per row of (page_id, url, html): request, response or revisit, and metadata.

    Payload: html in UTF-8, null as empty.  Of rows with equal payloads of LEAST_REVISIT bytes or more, that
    with the smallest page_id is the response; the others are revisits and hold the HTTP header only.
    Line ends in url are dropped; a null url is ``urn:none``, a null page_id ``none`` (nulls come last).
    Rows with equal page_id are one page: the first of them in the archives counts.  An empty table gives archives without
    records; other columns are not looked at.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", F.coalesce(F.regexp_replace("url", r"[\r\n]", ""), F.lit("urn:none")).alias("url"), html.alias("html"))
    rows = rows.withColumn("n", F.octet_length("html")).withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256))
    digests = pages.select("page_id", F.sha2(F.encode(html, "UTF-8"), 256).alias("digest"), F.octet_length(html).alias("n")).where(F.col("n") >= LEAST_REVISIT)
    groups = digests.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min("page_id").alias("first"))
    # Only groups of copies are stored: those of one page need no join.
    rows = rows.join(store(groups.where("copies > 1").select("digest", "first"), "warc-copies"), "digest", "left")
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    own = lambda kind, x=name: F.concat(F.lit(f"urn:page:{kind}:"), x)
    together = F.concat(F.lit(f"{CRLF}WARC-Concurrent-To: <"), own("response"), F.lit(">"))
    digest = F.concat(F.lit(f"{CRLF}WARC-Payload-Digest: sha256:"), F.col("digest"))
    http = F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF * 2}")
    ask = F.concat(F.lit("GET "), F.col("url"), F.lit(f" HTTP/1.1{CRLF * 2}"))
    note = F.concat(F.lit("page: "), name, F.lit(CRLF))
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    type_http = F.lit(f"{CRLF}Content-Type: application/http; msgtype=response")
    response = F.when(
        revisit,
        F.concat(_header("revisit", own("response"), F.col("url"), F.octet_length(http), F.lit(f"{CRLF}WARC-Profile: {PROFILE}{CRLF}WARC-Refers-To: <"), own("response", F.col("first").cast("string")), F.lit(">"), digest, type_http), http),
    ).otherwise(F.concat(_header("response", own("response"), F.col("url"), F.octet_length(http) + F.col("n"), digest, type_http), http, F.col("html")))
    records = F.array(
        F.concat(_header("request", own("request"), F.col("url"), F.octet_length(ask), together, F.lit(f"{CRLF}Content-Type: application/http; msgtype=request")), ask),
        response,
        F.concat(_header("metadata", own("metadata"), F.col("url"), F.octet_length(note), together, F.lit(f"{CRLF}Content-Type: application/warc-fields")), note),
    )

    def write(part: DataFrame, mode: str, pages_a_file: int) -> None:
        out = part.select(F.explode(records).alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
        out.mode(mode).option("maxRecordsPerFile", 3 * pages_a_file).text(path)

    longest = pages.agg(F.max(F.octet_length(html))).first()[0] or 0
    if longest <= LARGE:
        write(rows, "error", FILE_ROWS)
    else:
        write(rows.where(F.col("n") <= LARGE), "error", FILE_ROWS)
        write(rows.where(F.col("n") > LARGE), "append", max(1, FILE_BYTES // longest))


class _Reader:
    """Bytes of an archive, inflated as they are asked for."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.buffer, self.offset = memoryview(data), 0, bytearray(), 0
        self.zip = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None

    def more(self) -> bool:
        if self.at >= len(self.data) and not (self.zip and self.zip.unconsumed_tail):
            return False
        if self.zip is None:
            self.buffer += self.data[self.at : self.at + CHUNK]
            self.at += CHUNK
            return True
        took = self.zip.unconsumed_tail
        if not took:
            took = bytes(self.data[self.at : self.at + CHUNK])
            self.at += len(took)
        self.buffer += self.zip.decompress(took, 4 * CHUNK)
        if self.zip.eof:
            self.at -= len(self.zip.unused_data)
            self.zip = zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes | None:
        at = 0
        while (found := self.buffer.find(mark, at)) < 0:
            at = max(0, len(self.buffer) - len(mark))
            if not self.more():
                return None
        return self.take(found + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self.more():
            pass
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        self.offset += n
        return out


def parse(data: bytes) -> Iterator[tuple[int, list[tuple[str, str]], bytes]]:
    """(offset, header lines, block) of each record; offsets count inflated bytes.  A cut last record is dropped."""
    reader = _Reader(data)
    while (head := reader.until(b"\r\n\r\n")) is not None:
        start = reader.offset - len(head)
        lines = head.decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            continue
        fields = [(k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:] if x)]
        length = int(next((v for k, v in fields if k == "content-length"), "0") or 0)
        block = reader.take(length)
        if len(block) < length:
            return
        yield start, fields, block


def read_records(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row per record of all archives below ``path``; columns: RECORD_FIELDS.

    payload_bytes and payload_digest (bare lower-case hex SHA-256) are taken from the whole payload: of
    ``application/http`` blocks, what follows the HTTP header; null for revisits, which have none.
    ``payload=False`` leaves the bytes themselves out (null).
    """
    schema = T._parse_datatype_string(RECORD_FIELDS)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        rows, held = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                file, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                for offset, fields, block in parse(data):
                    one = dict(fields)
                    name = lambda k: (one.get(k) or "").strip("<>") or None  # noqa: B023, E731
                    http, body = "", block
                    if one.get("content-type", "").startswith("application/http"):
                        cut = block.find(b"\r\n\r\n")
                        http, body = (block[:cut].decode("utf-8", "replace"), block[cut + 4 :]) if cut >= 0 else ("", block)
                    kind = one.get("warc-type")
                    real = kind != "revisit"
                    rows.append({
                        "record_id": name("warc-record-id"), "record_type": kind, "concurrent_to": [v.strip("<>") for k, v in fields if k == "warc-concurrent-to"], "refers_to": name("warc-refers-to"),
                        "target_uri": one.get("warc-target-uri"), "date": one.get("warc-date"), "claimed_digest": one.get("warc-payload-digest", "").rpartition(":")[2] or None,
                        "payload_bytes": len(body) if real else None, "payload_digest": hashlib.sha256(body).hexdigest() if real else None, "http_header": http,
                        "payload": body if payload and real else None, "file": file, "offset": offset,
                    })
                    held += len(body) if payload else 0
                    if len(rows) >= 2_000 or held > 1 << 24:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, arrow)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return arrow(files, records, schema)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id``, ``response``, ``requests``, ``metadata``, ``revisit_of``, ``part``.

    A capture is a response or revisit record.  A request or metadata record belongs to the capture that it
    is concurrent to, or that is concurrent to it, directly or by way of one other record.  Records that
    lead to no capture form rows of their own, with a null response.  Records repeated under one id count
    once (the first by file and offset).  ``revisit_of`` is the response that a revisit refers to (its
    payload_bytes and payload_digest), null if it isn't there.  Arrays are in the order of record_id; a
    capture with over PART_ROWS other records gets further rows with part 1, 2 and so on.
    """
    narrow = store(records.drop("payload") if "payload" in records.columns and not _has_payload(records) else records, "warc-records")
    first = F.min(F.struct("file", "offset")).alias("at")
    chosen = narrow.groupBy("record_id").agg(first).select("record_id", "at.file", "at.offset")
    narrow = narrow.join(chosen, ["record_id", "file", "offset"], "left_semi")
    captures = narrow.where(F.col("record_type").isin("response", "revisit"))
    others = narrow.where(F.col("record_type").isin("request", "metadata"))
    said = narrow.select("record_id", F.explode("concurrent_to").alias("other"), F.col("record_type").isin("response", "revisit").alias("main"))
    links = said.select("record_id", "other").union(said.where("main").select(F.col("other").alias("record_id"), F.col("record_id").alias("other"))).distinct()
    direct = links.join(captures.select(F.col("record_id").alias("other")), "other").groupBy("record_id").agg(F.min("other").alias("capture_id"))
    direct = store(direct, "warc-links")
    left = others.select("record_id").join(direct, "record_id", "left_anti")
    both = links.union(links.select("other", "record_id").toDF("record_id", "other"))
    second = both.join(left, "record_id", "left_semi").join(direct.select(F.col("record_id").alias("other"), "capture_id"), "other").groupBy("record_id").agg(F.min("capture_id").alias("capture_id"))
    owner = direct.union(second.select("record_id", "capture_id"))
    body = F.struct(*[c for c in narrow.columns])
    placed = others.select("record_id", "record_type", body.alias("record")).join(owner, "record_id", "left")
    placed = placed.select(F.coalesce("capture_id", "record_id").alias("capture_id"), "record_type", "record")
    counts = placed.groupBy("capture_id").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("parts"))
    large = store(counts.where("parts > 1"), "warc-large")
    placed = placed.join(large, "capture_id", "left").withColumn("part", F.pmod(F.xxhash64("record.record_id"), F.coalesce("parts", F.lit(1))).cast("int"))
    pick = lambda kind: F.sort_array(F.collect_list(F.when(F.col("record_type") == kind, F.col("record"))))
    groups = placed.groupBy("capture_id", "part").agg(pick("request").alias("requests"), pick("metadata").alias("metadata"))
    main = captures.select(F.col("record_id").alias("capture_id"), F.lit(0).alias("part"), body.alias("response"))
    nested = main.join(groups, ["capture_id", "part"], "full")
    targets = captures.where("record_type = 'response'").select(F.struct("record_id", "payload_bytes", "payload_digest").alias("revisit_of"), F.col("record_id").alias("target"))
    out = nested.withColumn("target", F.col("response.refers_to")).join(targets, "target", "left")
    empty = F.array().cast(nested.schema["requests"].dataType)
    return out.select("capture_id", "part", "response", F.coalesce("requests", empty).alias("requests"), F.coalesce("metadata", empty).alias("metadata"), "revisit_of")


def _has_payload(records: DataFrame) -> bool:
    return bool(records.where("payload IS NOT NULL").limit(1).count())


def page_digests(captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of the captures that write_pages wrote."""
    page = lambda x: F.try_element_at(F.split(x, ":"), F.lit(-1)).try_cast("long")
    real = captures.where("response IS NOT NULL")
    return real.select(
        page(F.col("capture_id")).alias("page_id"),
        F.coalesce("response.payload_bytes", "revisit_of.payload_bytes").alias("payload_bytes"),
        F.coalesce("response.payload_digest", "revisit_of.payload_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        page(F.col("response.refers_to")).alias("refers_to"),
        F.size("requests").alias("n_requests"),
        F.size("metadata").alias("n_metadata"),
    )
