"""WARC archives with revisit records, written and read by Spark.

Headers alone are grouped by payload digest; of equal payloads of at least MIN_BYTES, that with the largest id keeps its
response and the others become revisits that refer to it (by record id, URI and date). Records get fresh headers (type, ids,
digests, lengths, dates) and every record is a gzip member of its own, so that archives can be read from any record's offset.

Tasks compress records and join members up to CHUNK_BYTES in a row; Spark's text writer puts CHUNKS rows in an archive. A gzip
member of less than 16 MB ends in a zero byte (the high byte of its length), which the writer sets as its line separator; after a
larger one comes an empty member. So archives hold members and nothing else, and are bounded in bytes but for one large record.
Archives are read back as binary files, a member at a time, parsed by their Content-Length fields; responses are checked
against their digests.

A record's date is that of the column fetched_at, or the time of writing where pages has none (or it is null). A null payload is
empty and a null url leaves its fields out; line breaks in a url are percent-encoded. Records with a null id are never the original
of others. Rows that repeat the largest id of a payload all stay responses. Record ids come from page id, url and digest: rows equal
in all three share one. An empty table gives an empty archive and an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lake

MIN_BYTES = 1000
#: Compressed bytes of a row of members, and rows in an archive.
CHUNK_BYTES, CHUNKS = 8 << 20, 8
#: Digests, and bytes of their urls, that may be broadcast to the pages (about 150 bytes each besides); beyond, they are joined by shuffle.
BROADCAST_DIGESTS, BROADCAST_BYTES = 200_000, 32 << 20
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def headers(pages: DataFrame) -> DataFrame:
    """page_id, url, html (never null), payload_bytes, payload_digest, date."""
    html = F.coalesce(F.col("html"), F.lit(""))
    raw = html.cast("binary")
    fetched = [F.col("fetched_at").cast("timestamp")] if "fetched_at" in pages.columns else []
    date = F.date_format(F.convert_timezone(None, F.lit("UTC"), F.coalesce(*fetched, F.current_timestamp()).cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return pages.select("page_id", "url", html.alias("html"), F.octet_length(raw).cast("long").alias("payload_bytes"), F.sha1(raw).alias("payload_digest"), date.alias("date"))


def resolved(records: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """records (as of headers) with record_type, refers_to, and the url and date of what they refer to."""
    top = F.max_by(F.struct("page_id", "url", "date"), "page_id").alias("original")
    again = records.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes").agg(top, F.count("*").alias("n"))
    again = lake.written(again.where("n > 1").select("payload_digest", "payload_bytes", "original"), "digests")
    n, size = again.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("original.url")), F.lit(0))).first()
    small = n <= BROADCAST_DIGESTS and size <= BROADCAST_BYTES
    df = records.join(again.hint("broadcast" if small else "merge"), ["payload_digest", "payload_bytes"], "left")
    revisit = F.col("original.page_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original.page_id"))
    given = lambda c: F.when(revisit, F.col(f"original.{c}"))
    return df.withColumns({"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": given("page_id"), "refers_url": given("url"), "refers_date": given("date")}).drop("original")


def _uuid(page_id: Column, url: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws(":", F.lit("page"), F.coalesce(page_id.cast("string"), F.lit("")), F.coalesce(url, F.lit("")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _uri(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "\r", "%0D"), "\n", "%0A")


def record_text() -> Column:
    """One record, with the CRLF CRLF that ends it."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    return F.concat(
        F.lit("WARC/1.1\r\n"), _field("WARC-Type", F.col("record_type")), _field("WARC-Record-ID", _uuid(F.col("page_id"), F.col("url"), F.col("payload_digest"))), _field("WARC-Date", F.col("date")), _field("WARC-Target-URI", _uri(F.col("url"))),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))), _field("WARC-Page-ID", F.col("page_id").cast("string")),
        F.when(revisit, F.concat(
            _field("WARC-Refers-To", _uuid(F.col("refers_to"), F.col("refers_url"), F.col("payload_digest"))), _field("WARC-Refers-To-Target-URI", _uri(F.col("refers_url"))), _field("WARC-Refers-To-Date", F.col("refers_date")),
            _field("WARC-Refers-To-Page-ID", F.col("refers_to").cast("string")), _field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        )).otherwise(F.lit("")),
        _field("Content-Type", F.lit("application/http; msgtype=response")), _field("Content-Length", length.cast("string")), F.lit("\r\n"), block, F.lit("\r\n\r\n"),
    )


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write(records: DataFrame, path: str) -> str:
    """Writes records (as of resolved) as archives in the folder path."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bytearray()

        def row() -> pa.RecordBatch:
            if held[-1]:
                held.extend(_member(b""))
            out = pa.RecordBatch.from_arrays([pa.array([bytes(held[:-1])], pa.binary())], names=["value"])
            held.clear()
            return out

        for batch in batches:
            for record in batch.column(0):
                held += _member(record.as_py())
                if len(held) >= CHUNK_BYTES:
                    yield row()
        if held:
            yield row()

    packed = lake.map_arrow(records.select(record_text().cast("binary").alias("record")), members, "value binary")
    packed.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", CHUNKS).text(path)
    return path


def _members(data: memoryview, step: int = 1 << 16) -> Iterator[bytes]:
    """The unpacked members of an archive, one at a time."""
    at = 0
    while at < len(data):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(data):
                raise ValueError("an archive ends within a record")
            parts.append(z.decompress(data[at : at + step]))
            at = min(at + step, len(data)) - len(z.unused_data)
        yield b"".join(parts)


def _parse(data: bytes) -> Iterator[dict]:
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].split(b"\r\n")
        if lines[0] != b"WARC/1.1":
            raise ValueError(f"no record at byte {at}")
        field = dict(x.split(b": ", 1) for x in lines[1:])
        start = end + 4
        end = start + int(field[b"Content-Length"])
        split = data.index(b"\r\n\r\n", start) + 4
        http = dict(x.split(b": ", 1) for x in data[start : split - 4].split(b"\r\n")[1:])
        page, refers = field.get(b"WARC-Page-ID"), field.get(b"WARC-Refers-To-Page-ID")
        kind, url = field[b"WARC-Type"].decode(), field.get(b"WARC-Target-URI")
        digest = field[b"WARC-Payload-Digest"].decode().removeprefix("sha1:")
        payload = data[split:end] if kind == "response" else None
        if payload is not None and hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"payload of page {page} doesn't have its digest")
        yield {
            "page_id": None if page is None else int(page), "url": None if url is None else url.decode(), "payload_bytes": int(http[b"Content-Length"]), "payload_digest": digest,
            "record_type": kind, "refers_to": None if refers is None else int(refers), "payload": payload,
        }
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"no record end at byte {end}")
        at = end + 4


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows of RECORD of all archives in the folder path."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for r in (r for member in _members(memoryview(content.as_buffer())) for r in _parse(member)):
                    rows.append(r)
                    size += len(r["payload"] or b"")
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return lake.map_arrow(spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content"), run, RECORD)


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write(resolved(headers(lake.table(spark, sf_dir, "pages"))), lake.new_path(spark, "warc"))
    return read(spark, path).drop("payload", "url")
