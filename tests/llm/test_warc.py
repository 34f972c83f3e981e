import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import warc

BIG = "<p>é WARC/1.1\r\n\r\nWARC-Type: response</p>\n" * 60
ROWS = [(1, "http://a/1", BIG), (2, "http://a/2\r\nX: y", BIG), (3, None, BIG), (4, "http://a/4", "small"), (5, "http://a/5", "small"), (6, "http://a/6", None), (7, "http://a/7", ""), (8, "http://a/8", "x" * 1000), (9, "http://a 9", "x" * 999),
        (10, "http://a/10", "\r\n\r\n"), (3, None, BIG), (8, "http://b", "x" * 1000), (11, "u", "é" * 500), (12, "u", "é" * 500)]


def brute(rows):
    last = {}
    for i, (page, _, html) in enumerate(rows):
        if len((html or "").encode()) >= 1000:
            last[html] = max(last.get(html, (page, i)), (page, i))
    out = []
    for i, (page, _, html) in enumerate(rows):
        data = (html or "").encode()
        revisit = html in last and last[html] != (page, i)
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", last[html][0] if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, size string")
    found = warc.archive_round_trip(pages, f"file://{tmp_path}/a").collect()
    assert sorted(map(tuple, found), key=str) == brute(ROWS)
    assert warc.archive_round_trip(pages.limit(0), f"file://{tmp_path}/b").collect() == []


def test_files_are_bounded_in_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 1 << 16)
    monkeypatch.setattr(warc, "FILE_CAPTURES", 64)
    sizes = [10] * 150 + [1024, 1025, 3000, 9000, 16384, 16385, 40_000, 65_536, 100_000, 300_000] * 4
    rows = [(i, f"http://a/{i}", chr(97 + i % 26) * n + str(i)) for i, n in enumerate(sizes)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    found = warc.archive_round_trip(pages, f"file://{tmp_path}/a").collect()
    assert sorted(map(tuple, found), key=str) == brute(rows)
    for file in (tmp_path / "a").glob("part-*"):
        payloads = [len(body.partition(b"\r\n\r\n")[2]) for head, body in warc.parse_records(gzip.open(file)) if head["warc-type"] == "response"]
        assert sum(payloads) <= 1 << 16 or len(payloads) == 1


def test_order_of_the_input_does_not_matter(spark, tmp_path):
    """An input whose rows come in another order each time that they are read."""
    rows = ROWS * 3
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").orderBy(F.rand())
    found = warc.archive_round_trip(pages, f"file://{tmp_path}/a").collect()
    assert sorted(map(tuple, found), key=str) == brute(rows)


def test_records_and_captures(spark, tmp_path):
    pages = spark.createDataFrame(ROWS[:4] + [(None, "http://n", "null id")], "page_id long, url string, html string")
    warc.write_archive(pages, f"file://{tmp_path}/a")
    records = warc.read_archive(spark, f"file://{tmp_path}/a")
    assert {r["type"]: r["count"] for r in records.groupBy("type").count().collect()} == {"request": 5, "response": 3, "revisit": 2, "metadata": 5}
    captures = warc.assemble(records).collect()
    assert len(captures) == 5 and all(len(c.metadata) == 1 and c.request.record_id for c in captures)
    payloads = {bytes(c.response.payload).decode() for c in captures if c.response.type == "response"}
    assert payloads == {BIG, "small", "null id"}
    alone = warc.assemble(records.where("type <> 'request'")).collect()
    assert len(alone) == 5 and all(c.request is None for c in alone)
    assert warc.assemble(records.where("type = 'metadata'")).count() == 0


def test_reader_takes_members_and_lengths(spark, tmp_path):
    record = lambda i, body: (f"WARC/1.0\r\nWARC-Type: resource\r\nwarc-record-id: <urn:{i}>\r\nContent-Length: {len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n"
    bodies = [b"", b"\x00\xff\r\n\r\nWARC/1.0\r\n", b"z" * 100_000]
    (tmp_path / "m.warc.gz").write_bytes(b"".join(gzip.compress(record(i, b)) for i, b in enumerate(bodies)))
    (tmp_path / "plain.warc").write_bytes(b"".join(record(i + 3, b) for i, b in enumerate(bodies)))
    rows = warc.read_archive(spark, f"file://{tmp_path}").orderBy("record_id").collect()
    assert [bytes(r.payload) for r in rows] == bodies * 2 and [r.payload_bytes for r in rows] == [len(b) for b in bodies] * 2
    with pytest.raises(ValueError):
        list(warc.parse_records(io.BytesIO(record(1, b"abc")[:-6])))
    with pytest.raises(ValueError):
        list(warc.parse_records(io.BytesIO(b"HTTP/1.1 200\r\n")))
