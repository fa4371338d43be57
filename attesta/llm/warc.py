"""WARC archives with revisit records.

Capturing. Every task streams its pages to an archive of its own in the shared folder, a gzip member each, and hands on
their headers only: id, address, payload digest and length, and where the member lies. Payloads move no further.

Resolving. Headers are shuffled by digest and salt, partial minima first, so that a payload that a third of the pages
share is spread over ``SALTS`` tasks. Digests that occur once drop out; the others' originals are sent back to just the
(digest, salt) cells that hold their copies, and the headers join them there. The record of least page_id (then url and
place) is the response; records of equal payloads of at least ``LEAST`` bytes become revisits of it. Smaller ones are
all responses.

Writing. Resolved headers are ranged by place, so that a task reads a stretch of captured archives from front to back;
it writes one deduplicated archive with headers made anew, a warcinfo record first. A revisit record holds no payload,
only the original's id, address and digest, and its captured member isn't read.

Reading. ``read`` walks the members of an archive as a stream, parses the headers, checks each response's payload
against its stated length and digest.

Edge cases: a null html is an empty payload; payloads of any length are taken whole; null page_ids sort last, and a
revisit of one has a null refers_to; of rows that repeat the least page_id one is the response and the others revisit
it; a null url is left out of the header; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .common import discard, remove, scratch, short_batches, table, written

LEAST = 100  #: bytes from which equal payloads are resolved
ARCHIVE, SHARE = 256 << 20, 4 << 20  #: bytes of captured members that make an archive; small corpora still share cores by the second
SALTS = 64  #: cells that one digest is spread over
DATE = "2024-01-01T00:00:00Z"  #: date stated in the records: an argument of the job, never the clock
CHUNK = 1 << 20

# Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


HEADS = "page_id long, url string, digest string, n_bytes long, path string, at long, size long"


def capture(pages: DataFrame, folder: str) -> DataFrame:
    """pages(page_id, url, html) written where they are read; the headers of their records (``HEADS``)."""
    short_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, path = None, 0, f"{folder}/{files.attempt_name()}.captured.gz"
        for b in batches:
            rows = []
            for page_id, url, html in zip(*(b.column(c) for c in range(3)), strict=True):
                out = out or files.create(path)
                payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                row = {"page_id": page_id.as_py(), "url": url.as_py(), "digest": hashlib.sha256(payload).hexdigest(), "n_bytes": len(payload)}
                data = member(record(row | {"revisit": False, "payload": payload}), 1)
                out.write(data)
                rows.append((*row.values(), path, at, len(data)))
                at += len(data)
            if rows:
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "url", "digest", "n_bytes", "path", "at", "size"])
        if out:
            out.close()

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode("html", "UTF-8").alias("html")).mapInArrow(run, HEADS)


def resolve(heads: DataFrame) -> DataFrame:
    """Headers with ``revisit`` and, where they revisit, the original's id and url."""
    heads = heads.withColumn("salt", F.pmod(F.xxhash64("path", "at"), F.lit(SALTS)).cast("int"))
    first = F.min(F.struct(F.col("page_id").isNull().alias("late"), "page_id", "url", "path", "at"))
    cells = heads.where(F.col("n_bytes") >= LEAST).groupBy("digest", "salt").agg(first.alias("first"), F.count("*").alias("n"))
    originals = (
        cells.groupBy("digest")
        .agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.collect_set("salt").alias("salts"))
        .where("n > 1")
        .select("digest", F.explode("salts").alias("salt"), "first")
    )
    revisit = F.col("first").isNotNull() & ~((F.col("path") == F.col("first.path")) & (F.col("at") == F.col("first.at")))
    return heads.join(originals, ["digest", "salt"], "left").select(
        "page_id", "url", "digest", "n_bytes", "path", "at", "size", revisit.alias("revisit"),
        F.when(revisit, F.col("first.page_id")).alias("original_id"), F.when(revisit, F.col("first.url")).alias("original_url"),
    )


def member(raw: bytes, level: int = 3) -> bytes:
    """A record as a gzip member."""
    z = zlib.compressobj(level, wbits=31)
    return z.compress(raw) + z.flush()


def _record_id(page_id: int | None, url: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}\n{url}\n{digest}')}>"


def _address(url: str) -> str:
    return quote(url, safe="".join(map(chr, range(33, 127))))


def record(row: dict, date: str = DATE) -> bytes:
    """One record: headers, then an HTTP message, whose body a revisit leaves out."""
    body = row.get("payload") or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['n_bytes']}\r\n\r\n".encode()
    block = http if row["revisit"] else http + body
    head = [
        ("WARC-Type", "revisit" if row["revisit"] else "response"),
        ("WARC-Record-ID", _record_id(row["page_id"], row["url"], row["digest"])),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha256:{row['digest']}"),
        ("X-Payload-Length", row["n_bytes"]),
    ]
    if row["url"] is not None:
        head.append(("WARC-Target-URI", _address(row["url"])))
    if row["page_id"] is not None:
        head.append(("X-Page-ID", row["page_id"]))
    if row["revisit"]:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(row["original_id"], row["original_url"], row["digest"])), ("WARC-Refers-To-Date", date)]
        if row["original_url"] is not None:
            head.append(("WARC-Refers-To-Target-URI", _address(row["original_url"])))
        if row["original_id"] is not None:
            head.append(("X-Refers-To-Page-ID", row["original_id"]))
    else:
        head.append(("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block, usedforsecurity=False).digest()).decode()))
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(block))]
    return f"{VERSION}\r\n{''.join(f'{k}: {v}\r\n' for k, v in head)}\r\n".encode() + block + b"\r\n\r\n"


def information(date: str = DATE) -> bytes:
    """The record that opens an archive."""
    body = b"software: attesta\r\nformat: WARC File Format 1.1\r\n"
    head = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, date)}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields"), ("Content-Length", len(body))]
    return f"{VERSION}\r\n{''.join(f'{k}: {v}\r\n' for k, v in head)}\r\n".encode() + body + b"\r\n\r\n"


def write(resolved: DataFrame, folder: str) -> DataFrame:
    """Writes the archives from captured members; a row for each: path, records, bytes."""
    spark = resolved.sparkSession
    total = resolved.agg(F.sum("size")).first()[0] or 0
    n = max(1, -(-total // ARCHIVE), min(2 * spark.sparkContext.defaultParallelism, -(-total // SHARE)))
    ranged = resolved.repartitionByRange(int(n), "path", "at").sortWithinPartitions("path", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n, size, path = None, 0, 0, f"{folder}/{files.attempt_name()}.warc.gz"
        source, opened = None, None
        for b in batches:
            for row in b.to_pylist():
                if out is None:
                    out = files.create(path)
                    out.write(data := member(information()))
                    size = len(data)
                if not row["revisit"]:
                    if opened != row["path"]:
                        if source:
                            source.close()
                        source, opened = files.source(row["path"]), row["path"]
                    source.seek(row["at"])
                    row["payload"] = parse(zlib.decompress(source.read(row["size"]), wbits=31))["payload"]
                out.write(data := member(record(row)))
                n, size = n + 1, size + len(data)
        if source:
            source.close()
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [n], "bytes": [size]})

    return ranged.mapInArrow(run, "path string, records long, bytes long")


def archive(pages: DataFrame, folder: str) -> DataFrame:
    """Deduplicated archives of pages(page_id, url, html) in ``folder``; a row for each."""
    caught = scratch(pages.sparkSession, "captured")
    heads = written(capture(pages, caught), "heads")
    resolved = written(resolve(heads), "resolved")
    out = written(write(resolved, folder), "warc-manifest")
    discard(heads, resolved)
    remove(pages.sparkSession, caught)
    return out


def members(stream: pa.NativeFile) -> Iterator[bytes]:
    """The uncompressed members of a gzip stream, one after another."""
    data = b""
    while data or (data := stream.read(CHUNK)):
        z, out = zlib.decompressobj(wbits=31), []
        while not z.eof:
            if not data and not (data := stream.read(CHUNK)):
                raise ValueError("an archive ends within a record")
            out.append(z.decompress(data))
            data = z.unused_data
        yield b"".join(out)


def parse(raw: bytes) -> dict:
    """A record's headers (lower-case names), its type and the payload behind the HTTP header (None for a revisit)."""
    at = raw.index(b"\r\n\r\n")
    first, *lines = raw[:at].decode().split("\r\n")
    if first != VERSION:
        raise ValueError(f"not a record: {first!r}")
    head = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
    block = raw[at + 4 : at + 4 + int(head["content-length"])]
    if raw[at + 4 + len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    payload = block[block.index(b"\r\n\r\n") + 4 :] if head["warc-type"] == "response" else None
    return head | {"payload": payload}


def read(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of the archives that ``manifest`` names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()] + [pa.binary()] * with_payload
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"] + ["payload"] * with_payload
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for b in batches:
            for path in b.column("path").to_pylist():
                rows: list[tuple] = []
                with files.source(path) as stream:
                    for raw in members(stream):
                        h = parse(raw)
                        if h["warc-type"] not in ("response", "revisit"):
                            continue
                        n, digest = int(h["x-payload-length"]), h["warc-payload-digest"].removeprefix("sha256:")
                        p = h["payload"]
                        if p is not None and (len(p) != n or hashlib.sha256(p).hexdigest() != digest):
                            raise ValueError(f"a payload in {path} differs from its header")
                        ids = [int(h[k]) if k in h else None for k in ("x-page-id", "x-refers-to-page-id")]
                        rows.append((ids[0], n, digest, h["warc-type"], ids[1], h.get("warc-target-uri"), *([p] if with_payload else [])))
                        if len(rows) == 256:
                            yield flush(rows)
                            rows = []
                if rows:
                    yield flush(rows)

    extra = ", payload binary" if with_payload else ""
    spread = manifest.select("path").repartition(max(8, manifest.sparkSession.sparkContext.defaultParallelism * 2), "path")
    return spread.mapInArrow(run, f"page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string{extra}")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(archive(table(spark, sf_dir, "pages"), scratch(spark, "warc")))


OP7_SQL = """
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, url, CAST(octet_length(b) AS BIGINT) AS n, sha256(b) AS h FROM p),
r AS (SELECT *, n >= 100 AND row_number() OVER (PARTITION BY h ORDER BY page_id NULLS LAST, url NULLS FIRST) > 1 AS again,
  first_value(page_id) OVER (PARTITION BY h ORDER BY page_id NULLS LAST, url NULLS FIRST) AS first FROM d)
SELECT page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN first END AS refers_to, url
FROM r
"""
