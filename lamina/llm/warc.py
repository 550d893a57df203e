"""WARC archives: a writer with revisit records and a splittable reader (operator 4).

Writer: one gzip member per record. Members are written by Spark's own text writer, so any Hadoop file system and
its commit protocol serve: a gzip member of less than 16 MiB ends in a zero byte (the high byte of its size), and
that zero byte is the line separator. A larger member is followed by an empty member, which ends in one.

Reader: a task takes a byte range, looks for gzip magic in it and takes a position for a record's start when the
member there decodes to a WARC header. It owns the records that start in its range and reads past the range's
end to finish the last one; everything inside a validated member is skipped, so magic bytes in compressed data
are not taken for starts. Between two tasks, such bytes would have to decode to a WARC header themselves.

Edge cases: null payloads are empty; a null URL leaves out the target URI; control characters and spaces of URLs
are percent-encoded; rows that share the largest id of equal payloads are all responses; null ids are written
without an id and read back as null, and count as smallest; an empty table writes no records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import fresh_dir

MAGIC, HEAD = b"\x1f\x8b\x08", b"WARC/1."
#: Bytes of a task's range; bytes read at a time.
RANGE_BYTES, WINDOW = 32 << 20, 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url, payload: bytes, sha: str, length: int, refers_to, date: str) -> bytes:
    """One record as a gzip member; a revisit if ``refers_to`` is given, without its payload."""
    revisit = refers_to is not None
    block = b"" if revisit else payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Date: {date}"]
    lines += [f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", f"WARC-Payload-Digest: sha1:{sha}", f"X-Payload-Length: {length}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        lines += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: text/html", f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n", 6, mtime=0)


def line_of(member: bytes) -> bytes:
    """The member without the zero byte that the writer's separator puts back."""
    if member[-1]:
        member += gzip.compress(b"", 6, mtime=0)
    return member[:-1]


def _lines(date: str):
    def run(batches):
        for b in batches:
            out = [line_of(record(i, u, p or b"", s, n, r, date)) for i, u, p, s, n, r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.record_batch([pa.array(out, pa.binary())], names=["value"])

    return run


def _digests(batches):
    for b in batches:
        yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array([digest(p or b"") for p in b.column(2).to_pylist()])], names=["id", "url", "payload", "sha"])


def write(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write a record per row of ``df`` under ``path``. Of equal payloads of at least ``least_bytes`` bytes the one with the largest id is the response, the others revisit it."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary")).alias("payload"))
    known = rows.mapInArrow(_digests, "id long, url string, payload binary, sha string")
    # the digests alone decide; texts are shuffled once, and a payload that many pages share is split by the skew join
    shared = known.groupBy("sha").agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    n = F.octet_length("payload").cast("long")
    marked = known.join(shared, "sha", "left").withColumn("n", n)
    marked = marked.withColumn("refers", F.when((F.col("n") >= least_bytes) & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.col("first")))
    body = F.when(F.col("refers").isNull(), F.col("payload"))
    lines = marked.select("id", "url", body.alias("payload"), "sha", "n", "refers").mapInArrow(_lines(date), "value binary")
    # the cast keeps the bytes as they are; the text writer copies them
    lines.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\x00").text(path)


class _Source:
    """Random access to a file through Arrow's file systems."""

    def __init__(self, uri: str):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri)
        self.file = system.open_input_file(path)
        self.size = self.file.size()

    def at(self, pos: int, n: int) -> bytes:
        return self.file.read_at(min(n, max(0, self.size - pos)), pos)


def members(source, start: int, end: int):
    """(position, content) of the records that start in [start, end)."""
    pos = start
    while pos < end:
        window = source.at(pos, min(WINDOW, end - pos) + len(MAGIC) - 1)
        hit = window.find(MAGIC)
        if hit < 0 or pos + hit >= end:
            pos += max(1, len(window) - len(MAGIC) + 1)
            continue
        pos += hit
        got = _member(source, pos)
        if got is None:
            pos += 1
            continue
        content, length = got
        yield pos, content
        pos += length


def _member(source, pos: int):
    """Content and length of the WARC member at ``pos``; None if there is none."""
    z, parts, read, headed = zlib.decompressobj(31), [], 0, False
    step = 4096
    while not z.eof:
        chunk = source.at(pos + read, step)
        if not chunk:
            return None
        try:
            parts.append(z.decompress(chunk))
        except zlib.error:
            return None
        read += len(chunk)
        step = WINDOW
        if not headed:
            head = b"".join(parts)[: len(HEAD)]
            if not HEAD.startswith(head[: len(HEAD)]) or z.eof and len(head) < len(HEAD):
                return None
            headed = len(head) == len(HEAD)
    return b"".join(parts), read - len(z.unused_data)


def parse(content: bytes) -> dict:
    """Headers (lower-cased names) and block of a record."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    fields = {k.lower(): v for k, v in fields.items()}
    n = int(fields.get("content-length", 0))
    return fields | {"block": rest[:n]}


def _page(urn: str | None):
    m = re.fullmatch(r"<urn:x-page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def _read(batches):
    for b in batches:
        for uri, start, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
            rows, held = [], 0
            for pos, content in members(_Source(uri), start, end):
                r = parse(content)
                kind = r.get("warc-type")
                payload = r["block"] if kind == "response" else None
                rows.append({"page_id": _page(r.get("warc-record-id")), "url": r.get("warc-target-uri"), "record_type": kind, "payload": payload, "payload_bytes": len(payload) if payload is not None else int(r.get("x-payload-length", 0)), "payload_digest": digest(payload) if payload is not None else r.get("warc-payload-digest", "").removeprefix("sha1:"), "refers_to": _page(r.get("warc-refers-to")), "uri": uri, "offset": pos})
                held += len(content)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _SCHEMA)


_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("uri", pa.string()), ("offset", pa.int64())])
_DDL = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long, uri string, offset long"


def read(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All records of the archives in ``path``, which every executor must be able to open through Arrow.

    The driver lists files and deals out ranges only. A response's bytes and digest are those of the payload that was read; a revisit's are those its headers give.
    """
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    ranges = []
    for f in fs.listStatus(jpath):
        name, size, uri = f.getPath().getName(), f.getLen(), f.getPath().toString()
        if not name.startswith(("_", ".")) and size:
            uri = re.sub(r"^file:/+", "file:///", uri)
            ranges += [(uri, at, min(at + range_bytes, size)) for at in range(0, size, range_bytes)]
    if not ranges:
        return spark.createDataFrame([], _DDL)
    return spark.createDataFrame(ranges, "uri string, start long, end long").repartition(len(ranges)).mapInArrow(_read, _DDL)


def op4_warc(spark, sf_dir: str) -> DataFrame:
    """Pages written as WARC archives and read back."""
    path = fresh_dir(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
with p as (select page_id, coalesce(octet_length(encode(html)), 0) as n, sha1(coalesce(html, '')) as h from pages),
d as (select *, max(page_id) over (partition by h) as top from p)
select page_id, cast(n as bigint) as payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(((cast('0x' || substr(h, 10 * (i // 8) + 1, 10) as bigint) >> (35 - 5 * (i % 8))) & 31) as int) + 1, 1) for i in range(32)], '') as payload_digest,
  case when page_id = top then 'response' else 'revisit' end as record_type,
  case when page_id <> top then top end as refers_to
from d
"""
