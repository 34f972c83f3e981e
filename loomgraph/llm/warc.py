"""WARC archives: writing page captures, reading records back, assembling transactions."""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from loomgraph.llm.shared import settle

VERSION = "WARC/1.1"
#: Payloads from this size on are stored once.
REVISIT_BYTES = 1000
#: A reader holds one file at a time, so files are bounded in payload bytes (a larger capture has a file for itself) and in captures.
FILE_BYTES, FILE_CAPTURES = 256 << 20, 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Date of captures that bring none of their own.
DATE = "2024-01-01T00:00:00Z"


def _record_id(kind: str, name: Column) -> Column:
    """A urn:uuid from the kind and what names the row."""
    h = F.md5(F.concat(F.lit(f"{kind}:"), name))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _line(name: str, value: Column | str) -> Column:
    """One header line, or nothing for null. Line ends in a value would break the header, so they go in as %0D and %0A."""
    value = F.lit(value) if isinstance(value, str) else value.cast("string")
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(F.regexp_replace(value, "\r", "%0D"), "\n", "%0A"), F.lit("\r\n")), F.lit(""))


def _record(kind: str, content_type: str, body: Column, *lines: Column) -> Column:
    """A record without its two closing line ends, which the writer's line separator adds."""
    head = [_line("WARC-Type", kind), _line("WARC-Record-ID", _record_id(kind, F.col("name"))), _line("WARC-Date", F.col("date")), _line("WARC-Target-URI", F.col("uri")), *lines, _line("Content-Type", content_type)]
    return F.concat(F.lit(f"{VERSION}\r\n"), *head, _line("Content-Length", F.octet_length(body)), F.lit("\r\n"), body)


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date_col: str | None = None) -> None:
    """Write gzip WARC files below `path`: for each row a request, a response or revisit, and a metadata record.

    Payloads are text and stored as UTF-8; null is the empty payload. Of rows with equal payloads of REVISIT_BYTES or more (equal
    SHA-256 and length) the one with the largest id (null ids last, ties to the largest hash of the row) is the response and the others
    refer to it. Request and metadata are concurrent to the response or revisit. The response is told by the row's content,
    not by its place, so the input may give its rows in another order when it is read again. Repeated rows are captures of their
    own: one of them is the response.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    date = F.date_format(F.col(date_col).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'") if date_col else F.lit(DATE)
    rows = pages.select(F.col(id_col).cast("string").alias("capture"), F.col(id_col).alias("order_id"), F.col(url_col).alias("uri"), payload.alias("payload"), F.coalesce(date, F.lit(DATE)).alias("date"))
    rows = rows.withColumn("sha256", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload")).withColumn("content", F.xxhash64("capture", "uri", "date", "sha256"))
    # the winners need no payload: the scan is read twice, and only one row per digest is joined
    largest = rows.agg(F.coalesce(F.max("size"), F.lit(0))).first()[0]
    alike = rows.where(F.col("size") >= REVISIT_BYTES).groupBy("sha256", "size", "order_id", "content").agg(F.count("*").alias("copies"))
    winner = alike.groupBy("sha256", "size").agg(F.max(F.struct("order_id", "content", "copies")).alias("last"), F.sum("copies").alias("n")).where("n > 1")
    winner = settle(winner.select(F.col("sha256").alias("w_sha256"), F.col("size").alias("w_size"), F.col("last.content").alias("w_content"), F.col("last.copies").alias("w_copies")), "winners")
    joined = rows.join(winner, (rows.sha256 == winner.w_sha256) & (rows["size"] == winner.w_size), "left")
    first = F.col("w_content") == F.col("content")
    if winner.where("w_copies > 1").isEmpty():
        kinds = joined.withColumn("revisit", F.coalesce(~first, F.lit(False)))
    else:
        several = F.coalesce(first & (F.col("w_copies") > 1), F.lit(False))
        place = F.row_number().over(Window.partitionBy("sha256", "size", "content").orderBy("content"))
        kinds = joined.where(~several).withColumn("revisit", F.coalesce(~first, F.lit(False))).unionByName(joined.where(several).withColumn("revisit", place > 1))
    told = lambda content: F.concat_ws("-", F.lit("first"), "sha256", F.col("size").cast("string"), F.col(content).cast("string"))
    # a response that others refer to is named by its content, any other row by its place in this one evaluation
    kinds = kinds.withColumn("name", F.when(F.col("w_content").isNotNull() & ~F.col("revisit"), told("content")).otherwise(F.concat_ws("-", F.col("content").cast("string"), F.monotonically_increasing_id().cast("string"))))
    kinds = kinds.withColumn("sha1", F.sha1("payload"))

    digest = _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1")))
    main_id = F.when(F.col("revisit"), _record_id("revisit", F.col("name"))).otherwise(_record_id("response", F.col("name")))
    target = F.col("uri")
    host = F.regexp_extract(F.coalesce(target, F.lit("")), r"://([^/?#]*)", 1)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    concurrent = _line("WARC-Concurrent-To", main_id)
    response = _record("response", "application/http; msgtype=response", F.concat(http, F.col("payload")), digest)
    revisit = _record("revisit", "application/http; msgtype=response", http, digest, _line("WARC-Refers-To", _record_id("response", told("w_content"))), _line("WARC-Profile", PROFILE))
    request = _record("request", "application/http; msgtype=request", F.concat(F.lit("GET "), F.coalesce(F.regexp_replace(target, r"\s", "%20"), F.lit("/")), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n")), concurrent)
    about = F.concat(F.coalesce(F.concat(F.lit("capture: "), F.col("capture"), F.lit("\r\n")), F.lit("")), F.lit("payload-bytes: "), F.col("size").cast("string"), F.lit("\r\n"))
    metadata = _record("metadata", "application/warc-fields", about, concurrent)
    records = F.concat_ws("\r\n\r\n", request, F.when(F.col("revisit"), revisit).otherwise(response), metadata)
    named = kinds.select(records.alias("value"), "size")
    low, high = -1, FILE_BYTES // FILE_CAPTURES
    while low < largest:  # classes of payload sizes, 16 times larger from one to the next: files of each hold FILE_BYTES at most
        last = high >= FILE_BYTES
        some = named.where((F.col("size") > low) & (F.lit(last) | (F.col("size") <= high))) if low >= 0 or high < largest else named
        some.select("value").write.mode("append").option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", 1 if last else max(1, FILE_BYTES // high)).text(path)
        low, high = (largest if last else high), high * 16


_FIELDS = ["record_id", "type", "uri", "date", "concurrent_to", "refers_to", "digest", "content_type"]
_NAMES = ["warc-record-id", "warc-type", "warc-target-uri", "warc-date", "warc-concurrent-to", "warc-refers-to", "warc-payload-digest", "content-type"]


def parse_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and body of each record. Bodies are taken by Content-Length, so they may hold anything."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            head[name.strip().lower()] = value.strip()
        length = int(head["content-length"])
        body = stream.read(length)
        if len(body) < length:
            raise ValueError(f"record {head.get('warc-record-id')} ends early")
        yield head, body


def _payload(kind: str, body: bytes) -> bytes:
    return body.partition(b"\r\n\r\n")[2] if kind in ("response", "revisit", "request") else body


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files (plain, gzip or a gzip member per record) below `path`, one row each.

    (record_id, type, uri, date, concurrent_to, refers_to, digest, content_type, payload, payload_bytes, payload_sha1); the
    payload is what follows the HTTP header, or the whole body of other records. A truncated or malformed file raises.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = content.as_buffer()
                raw = pa.BufferReader(data)
                stream = io.BufferedReader(gzip.GzipFile(fileobj=raw) if data.slice(0, 2).to_pybytes() == b"\x1f\x8b" else raw)
                rows = []
                for head, body in parse_records(stream):
                    payload = _payload(head["warc-type"], body)
                    rows.append([*(head.get(n) for n in _NAMES), payload, len(payload), hashlib.sha1(payload).hexdigest()])
                    if len(rows) == 500:
                        yield batch_of(rows)
                        rows = []
                yield batch_of(rows)

    def batch_of(rows: list) -> pa.RecordBatch:
        kinds = [pa.string()] * len(_FIELDS) + [pa.binary(), pa.int64(), pa.string()]
        columns = list(zip(*rows)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [*_FIELDS, "payload", "payload_bytes", "payload_sha1"])

    schema = ", ".join(f"{f} string" for f in _FIELDS) + ", payload binary, payload_bytes long, payload_sha1 string"
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, schema)


def assemble(records: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per capture: its response or revisit with the request and metadata records concurrent to it.

    (capture_id, uri, date, response struct, request struct, metadata array): a revisit's payload size and digest are those of
    the response it refers to. Records without a partner stay: a capture without a request has a null one, and records that
    name no capture at all are left out. Of several requests to a capture the first by record id is kept; metadata are in the
    order of record ids, as many as there are. Records with one id are one record.
    """
    columns = ["record_id", "type", "uri", "date", "refers_to", "digest", "payload_bytes", "payload_sha1", *(["payload"] if with_payload else [])]
    main = records.where(F.col("type").isin("response", "revisit")).select(*columns)
    partners = records.where(F.col("type").isin("request", "metadata") & F.col("concurrent_to").isNotNull())
    grouped = partners.groupBy(F.col("concurrent_to").alias("capture_id")).agg(
        F.min(F.when(F.col("type") == "request", F.struct("record_id", "uri", "payload"))).alias("request"),
        F.array_sort(F.collect_set(F.when(F.col("type") == "metadata", F.struct("record_id", "payload")))).alias("metadata"),
    )
    responses = main.where("type = 'response'")
    originals = responses.select(F.col("record_id").alias("refers_to"), F.col("payload_bytes").alias("o_bytes"), F.col("payload_sha1").alias("o_sha1"))
    revisits = main.where("type = 'revisit'").join(originals, "refers_to", "left")  # only rows that refer to something are dealt by it
    revisits = revisits.withColumn("payload_bytes", F.coalesce("o_bytes", "payload_bytes")).withColumn("payload_sha1", F.coalesce("o_sha1", F.substring("digest", 6, 40)))
    full = responses.unionByName(revisits.select(*responses.columns))
    response = F.struct("type", "refers_to", "payload_bytes", "payload_sha1", *(["payload"] if with_payload else []))
    captures = full.select(F.col("record_id").alias("capture_id"), "uri", "date", response.alias("response"))
    return captures.join(grouped, "capture_id", "left")


def archive_round_trip(pages: DataFrame, path: str) -> DataFrame:
    """Write `pages` to `path`, read the archives back and report each capture: page_id, payload_bytes, payload_digest,
    record_type, refers_to (page id of the response a revisit refers to)."""
    write_archive(pages, path)
    records = read_archive(pages.sparkSession, path)
    slim = settle(records.withColumn("payload", F.when(F.col("type") == "metadata", F.col("payload"))), "records")  # files are parsed once
    captures = assemble(slim, with_payload=False)
    page = F.regexp_extract(F.decode(F.col("metadata")[0]["payload"], "UTF-8"), r"(?m)^capture: (-?\d+)$", 1)
    told = settle(captures.select("capture_id", F.when(page != "", page).cast("long").alias("page_id"), "response.*"), "captures")
    of = told.where("type = 'response'").select(F.col("capture_id").alias("refers_to"), F.col("page_id").alias("o_page"))
    first = told.where("type = 'response'").withColumn("o_page", F.lit(None).cast("long"))
    later = told.where("type = 'revisit'").join(of, "refers_to", "left")
    joined = first.unionByName(later.select(*first.columns))
    return joined.select("page_id", "payload_bytes", F.col("payload_sha1").alias("payload_digest"), F.col("type").alias("record_type"), F.col("o_page").alias("refers_to"))


ROUND_TRIP_SQL = """
WITH sized AS (SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
marked AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS last FROM sized)
SELECT page_id, payload_bytes, sha1(payload) AS payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM marked
"""
