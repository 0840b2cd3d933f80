import base64
import gzip
import hashlib
import io
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from punctual.llm import archives
from punctual.llm.queries import oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
PAGES = [
    (5, "http://a.example/x y\r\nInjected: 1", "<p>same</p>"),
    (3, "http://b.example/", "<p>same</p>"),
    (9, None, "<p>same</p>"),
    (None, "http://c.example/", "<p>same</p>"),
    (1, "http://d.example/", None),
    (2, "http://d.example/", ""),
    (7, "http://e.example/é", "line\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n é日\U0001f600"),
    (8, "http://f.example/", "long " * 60_000),
    (8, "http://f.example/", "long " * 60_000),
    (4, "http://g.example/", "only here\r\n\r\n"),
]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def pages_frame(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash")).withColumn("first", F.lit(1))


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / "archives")


def test_pages_come_back_whole(spark, folder):
    frame = pages_frame(spark)
    archives.write_archives(frame.repartition(3), folder)
    got = archives.read_archives(spark, folder, with_payload=True).collect()
    least = {}
    for page_id, _, html in PAGES:
        if page_id is not None:
            least[html or ""] = min(page_id, least.get(html or "", page_id))
    want = []
    for page_id, url, html in PAGES:
        first = least[html or ""]
        kind = "response" if page_id == first else "revisit"
        safe = url and url.replace("\r", "%0D").replace("\n", "%0A").replace(" ", "%20")
        want.append((page_id, safe, kind, None if kind == "response" else first, digest(html), len((html or "").encode()), html or ""))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    narrow = archives.read_archives(spark, folder).collect()
    assert sorted(map(tuple, narrow), key=repr) == sorted((w[:6] for w in want), key=repr)


def test_files_are_valid_records_and_revisits_hold_no_payload(spark, folder):
    archives.write_archives(pages_frame(spark).coalesce(1), folder)
    files = list(Path(folder).glob("part-*.gz"))
    records = [r for f in files for r in archives.parse(io.BytesIO(gzip.decompress(f.read_bytes())))]
    assert len(records) == len(PAGES)
    for headers, block in records:
        assert headers["warc-payload-digest"].startswith("sha1:") and "injected" not in headers
        head, _, payload = block.partition(b"\r\n\r\n")
        assert head.startswith(b"HTTP/1.1 200 OK")
        if headers["warc-type"] == "revisit":
            assert not payload and headers["warc-refers-to"].startswith("<urn:x-page:")
        else:
            assert base64.b32encode(hashlib.sha1(payload).digest()).decode() == headers["warc-payload-digest"][5:]


def test_damaged_archives_are_errors():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    assert [b for _, b in archives.parse(io.BytesIO(record * 2))] == [b"abcd"] * 2
    for broken in (record[:-6], b"HTTP/1.1\r\n", record.replace(b"abcd", b"abcde")):
        with pytest.raises(ValueError):
            list(archives.parse(io.BytesIO(broken)))


def test_small_payloads_are_never_revisits(spark, folder, monkeypatch):
    monkeypatch.setattr(archives, "LEAST_BYTES", 100)
    archives.write_archives(pages_frame(spark), folder)
    kinds = {(r.page_id, r.payload_bytes): r.record_type for r in archives.read_archives(spark, folder).collect()}
    assert set(kinds.values()) == {"response"}


def test_no_pages(spark, folder):
    archives.write_archives(pages_frame(spark, []), folder)
    assert archives.read_archives(spark, folder).count() == 0


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{FOLDER}/pages.parquet'")
    want = con.execute(oracle_sql()["op10_warc_revisits"]).fetchall()
    assert sorted(map(tuple, queries()["op10_warc_revisits"](spark, FOLDER).collect())) == sorted(want)
