"""WARC archives with revisit records: written by Spark's text sink, read back as binary files."""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path, stash
from .common import lookup

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes that a reader gathers before it hands rows on.
BATCH_BYTES = 8 << 20


def _record_id(key: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("null")), digest))
    parts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def write_archive(pages: DataFrame, path: str, *, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 100, date: str | None = None) -> None:
    """Writes one record for each row of pages below path, as gzipped WARC 1.1 files.

    Of rows with equal payloads of at least min_bytes bytes, that with the smallest key is a response and the
    others are revisits of it without payload; all other rows are responses. Headers (key, url, digest, size) are
    shuffled by digest; pages move once, by key. A null html is an empty payload, a null url an empty target;
    line breaks and spaces in a url are percent-encoded. Rows that repeat the smallest key of their payload are
    responses too. A null key is never the smallest; payloads that only null keys have are all responses.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(F.col(html), F.lit(""))
    uri = F.coalesce(F.regexp_replace(F.regexp_replace(F.col(url), r"[\r\n]+", "%0A"), r"\s", "%20"), F.lit(""))
    rows = pages.select(F.col(key).alias("__key"), uri.alias("__uri"), payload.alias("__html"))
    rows = rows.withColumn("__digest", F.sha2(F.col("__html").cast("binary"), 256)).withColumn("__size", F.octet_length("__html"))
    headers = stash(rows.filter(F.col("__size") >= min_bytes).select("__key", "__uri", "__digest"), "warc-headers")
    first = headers.groupBy("__digest").agg(F.min("__key").alias("__first"), F.count(F.lit(1)).alias("__n"))
    first = first.filter("__n > 1 AND __first IS NOT NULL").select(F.col("__digest").alias("__d"), "__first")
    found = lookup(headers, first, "__digest", "__d", ["__first"]).filter(F.col("__first").isNotNull() & ~F.col("__key").eqNullSafe(F.col("__first")))
    plan = found.select(F.col("__key").alias("__pk"), F.col("__digest").alias("__pd"), "__first").distinct()
    joined = rows.join(plan, F.col("__key").eqNullSafe(F.col("__pk")) & (F.col("__digest") == F.col("__pd")), "left")
    revisit = F.col("__first").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("__size").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("__html")))
    # empty fields are left out
    fields = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("__key"), F.col("__digest"))),
        F.lit(f"WARC-Date: {date}"),
        F.when(F.col("__uri") != "", F.concat(F.lit("WARC-Target-URI: "), F.col("__uri"))),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("__digest")),
        F.when(revisit, f"WARC-Profile: {PROFILE}"),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("__first"), F.col("__digest")))),
        F.concat(F.lit("Page-ID: "), F.col("__key").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length("__block").cast("string")),
    ]
    record = F.concat(F.concat_ws("\r\n", *fields), F.lit("\r\n\r\n"), F.col("__block"), F.lit("\r\n"))
    # the sink's line separator is the second line break behind a record
    joined.withColumn("__block", block).select(record.alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


def parse_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of a WARC stream, by its content lengths."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.partition(b":")
            head[name.decode().strip().lower()] = value.decode().strip()
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a WARC record is cut off")
        yield head, block


def read_archive(spark: SparkSession, path: str, *, with_payload: bool = False) -> DataFrame:
    """(record_id, record_type, uri, page_id, refers_to_id, payload_digest, payload_bytes[, payload]) of each record.

    Digest and size are computed from the payload read (a response's HTTP body); a revisit has none of its own, so
    they are null. Files may be gzipped as a whole or by record. Records are handed on as they are read, so a task
    holds one compressed file and a few records.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "record_type", "uri", "page_id", "refers_to_id", "payload_digest", "payload_bytes"] + ["payload"] * with_payload
        kinds = [pa.string()] * 6 + [pa.int64()] + [pa.binary()] * with_payload
        rows, held = [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        for batch in batches:
            for item in batch.column(0):
                data = item.as_py()
                raw = io.BytesIO(data)
                stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if data[:2] == b"\x1f\x8b" else raw
                for h, block in parse_records(stream):
                    kind = h.get("warc-type")
                    if kind not in ("response", "revisit"):
                        continue
                    body = block.partition(b"\r\n\r\n")[2] if "application/http" in h.get("content-type", "") else block
                    own = kind == "response"
                    row = [h.get("warc-record-id"), kind, h.get("warc-target-uri"), h.get("page-id"), h.get("warc-refers-to"), hashlib.sha256(body).hexdigest() if own else None, len(body) if own else None]
                    rows.append(row + [body if own else None] * with_payload)
                    held += len(block) if with_payload else 400
                    if held > BATCH_BYTES:
                        yield out()
                        rows, held = [], 0
        if rows:
            yield out()

    schema = "record_id string, record_type string, uri string, page_id string, refers_to_id string, payload_digest string, payload_bytes long"
    return files.mapInArrow(run, schema + ", payload binary" * with_payload)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """records with refers_to, the page of a revisit's response, and that response's digest and size on the revisit."""
    records = stash(records, "warc-records")
    originals = records.filter("record_type = 'response'").groupBy("record_id").agg(F.min("page_id").alias("__page"), F.min("payload_digest").alias("__digest"), F.min("payload_bytes").alias("__bytes"))
    found = lookup(records.filter("record_type = 'revisit'"), originals, "refers_to_id", "record_id", ["__page", "__digest", "__bytes"])
    kept = records.filter("record_type = 'response'").select("record_id", "record_type", "uri", "page_id", "payload_digest", "payload_bytes", F.lit(None).cast("string").alias("refers_to"))
    seen = found.select("record_id", "record_type", "uri", "page_id", F.col("__digest").alias("payload_digest"), F.col("__bytes").alias("payload_bytes"), F.col("__page").alias("refers_to"))
    return kept.unionByName(seen)


def round_trip(pages: DataFrame, *, path: str | None = None, **options) -> DataFrame:
    """Writes pages as archives, reads them back and resolves revisits:
    (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    key = options.get("key", "page_id")
    kind = pages.schema[key].dataType.simpleString()
    write_archive(pages, path, **options)
    out = resolve_revisits(read_archive(spark, path))
    return out.select(F.col("page_id").cast(kind).alias(key), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


ORACLE = """
SELECT page_id, b AS payload_bytes, d AS payload_digest,
  CASE WHEN b >= 100 AND page_id IS DISTINCT FROM m AND m IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN b >= 100 AND page_id IS DISTINCT FROM m THEN m END AS refers_to
FROM (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS b, sha256(coalesce(html, '')) AS d,
        min(page_id) OVER (PARTITION BY sha256(coalesce(html, ''))) AS m FROM pages)
"""
