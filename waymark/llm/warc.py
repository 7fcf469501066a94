"""WARC archives of pages, deduplicated by revisit records.

Archives are written by Spark's text sink, whose line separator is the end of a WARC record, so a write is committed as
any other and survives lost executors; each file is gzip-compressed. They are read as whole files, record after record
by Content-Length, so nothing in a payload can end a record.

Revisits are resolved by headers alone: each archive gives a short row a record (place, id, payload size and SHA-256
of the payload as read), the rows are shuffled by digest with map-side combining, and records that aren't the original
of their digest become a list of decisions per archive. Archives meet their lists by path; one pass copies an archive
with fresh headers and leaves out the payloads of revisits. Payloads are never shuffled by digest, so a digest that a
third of all records share is no burden. An archive holds what one input split gave and records_per_file records at
most, and so do its headers and decisions.
"""

from __future__ import annotations

import datetime
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TEXT_BATCH_BYTES, TEXT_BATCH_ROWS, checkpointed, join_hot, text_batches

RECORDS_PER_FILE = 20_000
#: Fixed values of the WARC 1.1 format.
VERSION, END = "WARC/1.1", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http;msgtype=response"

HEADER_SCHEMA = "archive string, number long, record_type string, record_id string, page_id string, url string, captured string, payload_bytes long, payload_digest string, refers_record string"


def _write(records: DataFrame, folder: str, records_per_file: int) -> None:
    """The only column of records, one whole record a row, as gzip-compressed archives in folder."""
    records.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(folder)


def write_archives(pages: DataFrame, folder: str, id_col="page_id", url_col="url", html_col="html", captured: datetime.datetime | None = None, records_per_file: int = RECORDS_PER_FILE) -> None:
    """A response record per row of pages: an HTTP response whose payload is the html in UTF-8 (null: empty).

    A null id has no Page-Id field, a null url is empty; CR and LF in a url, which would end its field, are
    percent-encoded. Rows alike are records of their own. captured is WARC-Date, now if not given."""
    date = (captured or datetime.datetime.now(datetime.UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(F.col(html_col), F.lit(""))
    size = F.octet_length(payload)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit(END))
    hexed = F.md5(F.concat_ws("/", F.lit(folder), F.monotonically_increasing_id().cast("string")).cast("binary"))
    uuid = F.regexp_replace(hexed, "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")
    url = F.replace(F.replace(F.coalesce(F.col(url_col), F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    page = F.coalesce(F.concat(F.lit("\r\nPage-Id: "), F.col(id_col).cast("string")), F.lit(""))
    head = F.concat(F.lit(f"{VERSION}\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:"), uuid, F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), url, page, F.lit(f"\r\nContent-Type: {HTTP_TYPE}\r\nContent-Length: "), (F.octet_length(http) + size).cast("string"), F.lit(END))
    _write(pages.select(F.concat(head, http, payload)), folder, records_per_file)


def parse(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields, by lower-case name, and block of each record of one archive; ValueError if it is damaged."""
    stream = gzip.GzipFile(fileobj=source)
    while line := stream.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.removesuffix(b"\r\n").partition(b":")
            fields[name.decode().lower()] = value.removeprefix(b" ").decode("utf-8", "replace")
        block = stream.read(int(fields["content-length"]))
        if len(block) < int(fields["content-length"]):
            raise ValueError("the archive ends within a record")
        yield fields, block


def payload_of(block: bytes) -> bytes:
    """What follows the head of an HTTP message."""
    return block.partition(END.encode())[2]


def _files(spark: SparkSession, folder: str) -> DataFrame:
    text_batches(spark)
    return spark.read.format("binaryFile").load(folder).select(F.col("path").alias("archive"), "content")


def _header(archive: str, number: int, fields: dict[str, str], payload: bytes) -> tuple:
    kind = fields["warc-type"]
    digest = hashlib.sha256(payload).hexdigest() if kind == "response" else fields["warc-payload-digest"].removeprefix("sha256:")
    return archive, number, kind, fields["warc-record-id"], fields.get("page-id"), fields.get("warc-target-uri"), fields["warc-date"], len(payload) if kind == "response" else None, digest, fields.get("warc-refers-to")


def read_archives(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """A row per record of the archives in folder: its place, type, ids, url and date as text, the size and SHA-256 of
    the payload as read (of a revisit: none, and the digest that it states), the record it refers to, and with payloads
    the payload itself. A damaged archive fails the query. An empty folder gives no rows."""
    schema = HEADER_SCHEMA + ", payload binary" * payloads
    arrow = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]]) for c in schema.split(", ")])

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                rows, held = [], 0
                for number, (fields, block) in enumerate(parse(pa.BufferReader(content.as_buffer()))):
                    payload = payload_of(block)
                    rows.append((*_header(path, number, fields, payload), *[payload] * payloads))
                    held += len(payload) * payloads
                    if len(rows) >= TEXT_BATCH_ROWS or held >= TEXT_BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)], schema=arrow)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)], schema=arrow)

    return _files(spark, folder).mapInArrow(run, schema)


def decide(headers: DataFrame, least_bytes: int = 100, id_type: str = "long") -> DataFrame:
    """archive, number of each record to become a revisit, and id, url and date of the original it refers to.

    Of records whose payloads of at least least_bytes are equal, the one with the least page id stays (null ids last,
    repeated ids by place)."""
    place = F.struct(F.col("page_id").isNull().alias("unnamed"), F.col("page_id").cast(id_type).alias("id"), "archive", "number", "record_id", "url", "captured")
    long_ones = headers.filter((F.col("record_type") == "response") & (F.col("payload_bytes") >= least_bytes))
    grouped = long_ones.groupBy("payload_digest").agg(F.min(place).alias("original"), F.count(F.lit(1)).alias("n"))
    repeated = checkpointed(grouped.filter("n > 1"))
    met = join_hot(long_ones.select("archive", "number", "payload_digest"), repeated, "payload_digest")
    return met.filter("archive <> original.archive OR number <> original.number").select("archive", "number", "original.record_id", "original.url", "original.captured")


def _rendered(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"{VERSION}\r\n{head}Content-Length: {len(block)}{END}".encode() + block


def _fresh(fields: dict[str, str], block: bytes, original: dict | None) -> bytes:
    """The record with new headers: as it is, or as a revisit of the original, with the HTTP head alone."""
    payload = payload_of(block)
    kept = block if original is None else block[: len(block) - len(payload)]
    refers = [] if original is None else [("WARC-Profile", PROFILE), ("WARC-Refers-To", original["record_id"]), ("WARC-Refers-To-Target-URI", original["url"]), ("WARC-Refers-To-Date", original["captured"])]
    digest = lambda b: f"sha256:{hashlib.sha256(b).hexdigest()}"
    return _rendered([("WARC-Type", "response" if original is None else "revisit"), ("WARC-Record-ID", fields["warc-record-id"]), ("WARC-Date", fields["warc-date"]), ("WARC-Target-URI", fields.get("warc-target-uri")), *refers, ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(kept)), ("Page-Id", fields.get("page-id")), ("Content-Type", HTTP_TYPE)], kept)


def deduplicate(spark: SparkSession, source: str, target: str, least_bytes: int = 100, id_type: str = "long", records_per_file: int = RECORDS_PER_FILE) -> None:
    """The archives of the folder source written anew to target, with revisit records for repeated payloads."""
    decisions = decide(checkpointed(read_archives(spark, source)), least_bytes, id_type)
    listed = decisions.groupBy("archive").agg(F.collect_list(F.struct("number", "record_id", "url", "captured")).alias("revisits"))

    def run(batches):
        for b in batches:
            for content, revisits in zip(b.column("content"), b.column("revisits").to_pylist()):
                originals = {r["number"]: r for r in revisits or []}
                out, held = [], 0
                for number, (fields, block) in enumerate(parse(pa.BufferReader(content.as_buffer()))):
                    out.append(_fresh(fields, block, originals.get(number)))
                    held += len(out[-1])
                    if held >= TEXT_BATCH_BYTES or len(out) >= TEXT_BATCH_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    copied = _files(spark, source).join(listed.hint("shuffle_hash"), "archive", "left").mapInArrow(run, "record binary")
    _write(copied.select(F.col("record").cast("string")), target, records_per_file)


def resolve(records: DataFrame, id_type: str = "long") -> DataFrame:
    """A row per record of deduplicated archives: page_id, payload_bytes and payload_digest of the full payload,
    record_type, refers_to (page id of the original, null for responses), intact (a revisit states the digest of the
    payload that its original was read with).

    A revisit whose original isn't among the records keeps its digest, has no size and is not intact."""
    responses = records.filter("record_type = 'response'")
    revisits = records.filter("record_type = 'revisit'")
    named = F.col("page_id").cast(id_type).alias("page_id")
    asked = revisits.groupBy(F.col("refers_record").alias("record_id")).agg(F.count(F.lit(1)).alias("n"))
    originals = responses.select("record_id", F.col("page_id").cast(id_type).alias("refers_to"), F.col("payload_bytes").alias("full_bytes"), F.col("payload_digest").alias("full_digest"))
    originals = checkpointed(asked.join(originals, "record_id", "left"))
    pointing = revisits.select(F.col("refers_record").alias("record_id"), named, "payload_digest", "record_type")
    met = join_hot(pointing, originals, "record_id").select("page_id", F.col("full_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", F.coalesce(F.col("full_digest") == F.col("payload_digest"), F.lit(False)).alias("intact"))
    return responses.select(named, "payload_bytes", "payload_digest", "record_type", F.lit(None).cast(id_type).alias("refers_to"), F.lit(True).alias("intact")).unionByName(met)


def duckdb_sql() -> str:
    """The rows of resolve() over deduplicated archives of pages, by windows."""
    return """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to, true AS intact FROM f
"""
