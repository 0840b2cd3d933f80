"""Deduplicated WARC archives with revisit records.

Writing: every page's header (digest, size) is computed where the page is read; the least page of
each repeated digest is found on headers alone, and one join by digest tells every page whether it
is the original response or a revisit of it. Records are written by Spark's text writer, whose line
separator is the two line ends that close a WARC record.

Reading: archives come back as binary files and are parsed by Content-Length; revisits are joined
to the responses they name.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import prepare_workers, stored

#: Payloads below this many bytes are never revisits.
LEAST_BYTES = 0
#: Records of one archive file: bounds what a reader holds of a file.
FILE_RECORDS = 2_000
DATE = "2024-01-01T00:00:00Z"
_CRLF = "\r\n"
_RECORD = "urn:x-page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hexadecimal digits are four base-32 digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _header_safe(value: Column) -> Column:
    """A header value on one line: control characters and blanks are percent-encoded."""
    plain = F.regexp_replace(value, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", "")
    for char, code in ((" ", "%20"), ("\t", "%09"), ("\r", "%0D"), ("\n", "%0A")):
        plain = F.replace(plain, F.lit(char), F.lit(code))
    return plain


def resolved(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, original): original is set on revisits only."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    records = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        base32_sha1(payload).alias("payload_digest"),
    )
    firsts = (
        records.where(F.col("payload_bytes") >= LEAST_BYTES)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    revisit = (F.col("payload_bytes") >= LEAST_BYTES) & ~F.col("first").eqNullSafe(F.col("page_id"))
    return records.join(firsts, "payload_digest", "left").select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(revisit, F.col("first")).alias("original")
    )


def records(pages: DataFrame, date: str = DATE) -> DataFrame:
    """One column ``value``: each page's WARC record without the two line ends that close it."""
    r = resolved(pages)
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit(_CRLF + _CRLF),
    )
    revisit = F.col("original").isNotNull()
    block = F.when(revisit, head).otherwise(F.concat(head, F.col("payload")))
    lines = F.concat_ws(
        _CRLF,
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit(f"WARC-Record-ID: <{_RECORD}"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(">")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), _header_safe(F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(revisit, F.lit(f"WARC-Profile: {_PROFILE}")),
        F.when(revisit, F.concat(F.lit(f"WARC-Refers-To: <{_RECORD}"), F.col("original").cast("string"), F.lit(">"))),
        F.when(revisit, F.lit(f"WARC-Refers-To-Date: {date}")),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return r.select(F.concat(lines, F.lit(_CRLF + _CRLF), block).alias("value"))


def write_archives(pages: DataFrame, folder: str, date: str = DATE) -> None:
    """Write the pages (page_id, url, html, other columns ignored) as gzip-compressed WARC files below ``folder``.

    Of pages with equal payloads of at least ``LEAST_BYTES`` bytes the one with the smallest page_id
    is a response, the others are revisits without a payload; smaller payloads are all responses.
    A null html is an empty payload, a null url a record without target. Rows that repeat the
    smallest page_id are all responses. Pages without page_id are revisits of one that has one.
    """
    records(pages, date).write.option("lineSep", _CRLF * 2).option("compression", "gzip").option(
        "maxRecordsPerFile", FILE_RECORDS
    ).text(folder)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of one archive."""
    while True:
        version = stream.readline()
        if not version:
            return
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {version[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {headers.get('warc-record-id')} is cut off")
        yield headers, block


def _page(value: str | None) -> int | None:
    found = re.fullmatch(rf"<{_RECORD}(-?\d+)>", value or "")
    return int(found[1]) if found else None


def _read(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
    types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())
    wanted = len(names) - (not with_payload)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(columns)[:wanted], types[:wanted], strict=True)], names=names[:wanted])

    for batch in batches:
        for content in batch.column("content"):
            packed = io.BytesIO(content.as_py())
            stream = gzip.GzipFile(fileobj=packed) if packed.getbuffer()[:2] == b"\x1f\x8b" else packed
            rows, held = [], 0
            for headers, block in parse(stream):
                _, _, payload = block.partition(b"\r\n\r\n")
                kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
                response = kind == "response"
                if response and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"payload of {headers['warc-record-id']} does not have its digest")
                rows.append(
                    (
                        _page(headers["warc-record-id"]), headers.get("warc-target-uri"), kind, _page(headers.get("warc-refers-to")),
                        digest, len(payload) if response else None, payload.decode("utf-8", "replace") if response and with_payload else None,
                    )
                )
                held += len(payload) * with_payload
                if len(rows) >= 1_000 or held > 8 << 20:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)


def read_archives(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """The records of all archives below ``folder``, with revisits resolved through the responses they name.

    Columns page_id, url, record_type, refers_to, payload_digest, payload_bytes and, if asked for,
    payload: for revisits the last two come from the response. Every response's digest is checked.
    A folder without archives gives an empty table; a cut-off record is an error.
    """
    prepare_workers(spark)
    schema = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long"
    schema += ", payload string" if with_payload else ""
    extra = ["payload_bytes", *["payload"] * with_payload]
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    found = files.option("pathGlobFilter", "*.txt*").load(folder).select("content").mapInArrow(lambda b: _read(b, with_payload), schema)
    found = found if with_payload else stored(found, "headers")  # headers are narrow; payloads are parsed again instead
    responses = (
        found.where("record_type = 'response'")
        .select(F.col("page_id").alias("original"), F.col("payload_digest").alias("digest"), *[F.col(c).alias(f"of_{c}") for c in extra])
        .dropDuplicates(["original"])
    )
    revisits = found.where("record_type = 'revisit'").join(
        responses, (F.col("refers_to") == F.col("original")) & (F.col("payload_digest") == F.col("digest")), "left"
    )
    kept = ["page_id", "url", "record_type", "refers_to", "payload_digest"]
    return found.where("record_type != 'revisit'").select(*kept, *extra).unionByName(
        revisits.select(*kept, *[F.col(f"of_{c}").alias(c) for c in extra])
    )
