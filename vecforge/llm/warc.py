"""WARC archives: one gzip member per record, and a sequential reader that verifies what it reads."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecforge.llm.common import HOT_ROWS, HOT_SHARE, Scratch, prepare, skew_join

#: Equal payloads of at least so many bytes are stored once.
REVISIT_BYTES = 100
#: An archive closes after the record that makes it this long.
ARCHIVE_BYTES = 512 << 10
#: The reader inflates so many compressed bytes at a time.
READ_BYTES = 64 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EPOCH = datetime(2020, 1, 1, tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def label(data: bytes) -> str:
    return "sha256:" + base64.b32encode(hashlib.sha256(data).digest()).decode()


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))]) + "\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def clean(url: str | None) -> str:
    """A URL that fits a header line."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")


def record_id(page_id: int, payload: bytes) -> str:
    """The id of a page's response; pages that share a page_id but not the payload have ids of their own."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}:{label(payload)}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, place: str) -> bytes:
    """A response, or with refers_to (the page_id of the response) a revisit that holds the headers only."""
    own = record_id(page_id, payload) if refers_to is None and page_id is not None else f"<urn:uuid:{uuid.uuid5(_SPACE, f'row:{place}:{page_id}')}>"
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", own), ("WARC-Date", _EPOCH), ("WARC-Target-URI", clean(url)), ("X-Page-Id", "" if page_id is None else str(page_id)), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", label(payload))]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is not None:
        headers += [("WARC-Refers-To", record_id(refers_to, payload)), ("WARC-Profile", PROFILE)]
        payload = b""
    block = http + payload
    return member([*headers, ("WARC-Block-Digest", label(block))], block)


class BadRecord(ValueError):
    """An archive that breaks the format or fails a digest."""


def members(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The inflated content of each gzip member, fed chunk by chunk; BadRecord for a cut member or bytes that are none."""
    z, parts, fed = zlib.decompressobj(31), [], False
    for chunk in chunks:
        while chunk:
            try:
                parts.append(z.decompress(chunk))
            except zlib.error as e:
                raise BadRecord(f"not a gzip member: {e}") from None
            fed, chunk = True, z.unused_data
            if z.eof:
                yield b"".join(parts)
                z, parts, fed = zlib.decompressobj(31), [], False
    if fed:
        raise BadRecord("the last gzip member ends early")


def headers_of(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def read_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of one inflated member, framed by Content-Length."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/1.") or not mark:
        raise BadRecord("no WARC header")
    headers = headers_of(head)
    length = headers.get("content-length", "")
    if not length.isdigit() or rest[int(length) :] != b"\r\n\r\n":
        raise BadRecord(f"Content-Length {length!r} does not frame the block")
    block = rest[: int(length)]
    if headers.get("warc-block-digest", label(block)) != label(block):
        raise BadRecord("the block's digest differs")
    return headers, block


def read_archive(blob: bytes, chunk: int = READ_BYTES) -> Iterator[dict]:
    """A dict per record: page_id, url, record_type, record_id, refers_to (a record id or None), payload (None for revisits), digest (hex)."""
    for data in members(blob[i : i + chunk] for i in range(0, len(blob), chunk)):
        headers, block = read_record(data)
        kind = headers.get("warc-type")
        http, mark, payload = block.partition(b"\r\n\r\n")
        said = headers.get("warc-payload-digest", "")
        if not mark or not http.startswith(b"HTTP/") or not said.startswith("sha256:"):
            raise BadRecord("not an HTTP response with a payload digest")
        if kind == "response" and (said != label(payload) or int(headers_of(http)["content-length"]) != len(payload)):
            raise BadRecord("the payload's digest or length differs")
        if kind == "revisit" and not headers.get("warc-refers-to"):
            raise BadRecord("a revisit refers to no record")
        page = headers.get("x-page-id")
        yield {"page_id": int(page) if page else None, "url": headers.get("warc-target-uri", ""), "record_type": kind, "record_id": headers.get("warc-record-id"), "refers_to": headers.get("warc-refers-to"), "payload": payload if kind == "response" else None, "digest": base64.b32decode(said[7:]).hex()}


def _write(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, made, stem = [], 0, 0, uuid.uuid4().hex
        out = lambda: pa.RecordBatch.from_arrays([pa.array([f"{stem}-{made:06d}.warc.gz"]), pa.array([b"".join(parts)], pa.binary())], ["archive", "content"])
        n = 0
        for batch in batches:
            for page, url, html, ref in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to")), strict=True):
                parts.append(record(page.as_py(), url.as_py(), (html.as_py() or "").encode("utf-8", "surrogatepass"), ref.as_py(), f"{stem}:{n}"))
                n += 1
                size += len(parts[-1])
                if size >= limit:
                    yield out()
                    parts, size, made = [], 0, made + 1
        if parts:
            yield out()

    return run


def write_archives(pages: DataFrame, spark: SparkSession, scratch: Scratch, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """A table (archive, content): the bytes of the .warc.gz files that hold a record per row of ``pages``.

    They are kept as a table in the cluster's shared folder because executors have no common file system
    but Spark's; each content is a valid .warc.gz file. Of rows with equal payloads of at least
    ``revisit_bytes`` bytes, the one with the smallest page_id is a response and the others refer to it.
    """
    prepare(spark)
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    first = scratch.write(slim.filter((F.octet_length("html") >= revisit_bytes) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("times")).filter("times > 1"), "first")
    total = first.agg(F.sum("times")).first()[0] or 0
    hot = first.filter(F.col("times") > max(HOT_ROWS, total // HOT_SHARE)).select("digest", "first")  # HOT_SHARE rows at most
    few = slim.join(F.broadcast(hot), "digest", "left_anti")
    planned = slim.join(F.broadcast(hot), "digest").unionByName(few.join(first.select("digest", "first"), "digest", "left"))
    referred = planned.select("page_id", "url", "html", F.when(F.col("first") < F.col("page_id"), F.col("first")).alias("refers_to"))
    return scratch.write(referred.mapInArrow(_write(ARCHIVE_BYTES), "archive string, content binary"), "archives")


_FIELDS = (("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("digest", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column("content"):
            rows = []
            for r in read_archive(blob.as_py()):
                payload = r.pop("payload")
                rows.append(r | {"payload_bytes": None if payload is None else len(payload)})
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in _FIELDS], [k for k, _ in _FIELDS])


def read_archives(archives: DataFrame, scratch: Scratch) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of every record.

    Each archive is read in sequence by one task: members are inflated 64 KB at a time, blocks framed by
    Content-Length, block and payload digests verified; a breach raises BadRecord. A revisit stores no
    payload: its length, and the page_id that refers_to gives, come from the response that
    WARC-Refers-To names. One that is in no archive, or has another payload digest, is an error.
    """
    read = scratch.write(archives.mapInArrow(_read, "page_id long, url string, payload_bytes long, digest string, record_type string, record_id string, refers_to string"), "records")
    stored = read.filter("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to")).agg(F.max("page_id").alias("at"), F.max("payload_bytes").alias("stored_bytes"), F.max("digest").alias("stored_digest"))
    revisits = skew_join(read.filter("record_type = 'revisit'"), stored, ["refers_to"], "left")
    said = F.when(F.col("stored_digest").isNull(), F.raise_error(F.concat(F.lit("a revisit refers to a missing record: "), "refers_to"))).when(F.col("stored_digest") != F.col("digest"), F.raise_error(F.concat(F.lit("a revisit differs from the record it refers to: "), "refers_to"))).otherwise(F.col("stored_bytes"))
    columns = lambda df, size, at: df.select("page_id", "url", size.alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", at.alias("refers_to"))
    return columns(read.filter("record_type = 'response'"), F.col("payload_bytes"), F.lit(None).cast("long")).unionByName(columns(revisits, said, F.col("at")))


def roundtrip(pages: DataFrame, spark: SparkSession) -> DataFrame:
    """Write the archives of ``pages`` and read them back: a row per row of ``pages``.

    A null html is an empty payload. Rows that repeat the smallest page_id of a payload are each a
    response, with one record id, which names them all; rows without a page_id are responses, too, and
    rows that share a page_id with other payloads are records of their own. Extra columns are ignored; an empty table gives
    an empty one.
    """
    scratch = Scratch(spark, "warc")
    return read_archives(write_archives(pages, spark, scratch), scratch).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, octet_length(encode(html)) AS n, sha256(html) AS d FROM p),
r AS (SELECT *, CASE WHEN n >= {REVISIT_BYTES} AND page_id IS NOT NULL THEN min(CASE WHEN n >= {REVISIT_BYTES} THEN page_id END) OVER (PARTITION BY d) END AS f FROM q)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN f < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f < page_id THEN f END AS refers_to FROM r
"""
