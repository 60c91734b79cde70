"""Operator 2: WARC archives with a splittable reader.

``write_archives`` writes one gzip member per record (a response with its payload, or a revisit
that names the response with the same payload).  ``read_archives`` cuts the archives into byte
ranges.  The task of a range looks for gzip magic inside it; a candidate counts as the start of a
member when its first bytes inflate to a WARC version line.  The task owns the records that start
inside its range and reads a record's tail beyond the range's end where needed, so every record is
read once whatever the ranges.

Of records with equal payloads (at least ``min_payload`` bytes) the one with the largest id is the
response, the others revisit it.  Edge cases: a NULL payload counts as empty; a NULL url becomes
"urn:page:<id>"; blanks and line breaks in urls are percent-encoded; rows with a NULL id are
written as records named by their digest, read back with a NULL id, and a response only when no row
with an id has their payload (``null_ids=False`` refuses them with an error that names the column); rows with equal ids and equal payloads
are written once each, the response first; payloads that contain gzip or WARC bytes do no harm, as a
task goes on after a member's end; extra columns don't matter; an empty table gives no archives and
an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lookalike.llm.common import prepare, shared_folder, text_slices, written
from lookalike.llm.files import byte_ranges, open_input, open_output

# Fixed values of the formats.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
RECORD_DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

BLOCK_BYTES = 4 << 20
PROBE_BYTES = 4096
RECORD = "file string, offset long, page_id long, record_type string, refers_to long, url string, payload_bytes long, payload_digest string, payload binary"


def payload_digest(payload: bytes) -> str:
    return b32encode(hashlib.sha1(payload).digest()).decode()


def record_name(page_id: int | None, digest: str) -> str:
    return f"urn:sha1:{digest}" if page_id is None else f"urn:page:{page_id}"


def record_bytes(page_id: int | None, url: str, payload: bytes, digest: str, length: int, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has no payload but names the response it stands for."""
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (payload if refers_to is None else b"")
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_name(page_id, digest)}>", f"WARC-Date: {RECORD_DATE}",
             f"WARC-Target-URI: {re.sub(r'[\x00-\x20]', lambda m: f'%{ord(m.group()):02X}', url)}",
             f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {length}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def _sha1(payload: str):
    return F.sha1(F.encode(F.coalesce(payload, F.lit("")), "UTF-8"))


def decide(pages: DataFrame, min_payload: int = 0, ids: str = "page_id", payload: str = "html") -> DataFrame:
    """(page_id, digest, refers_to) of the records that are revisits."""
    light = pages.select(F.col(ids).cast("long").alias("page_id"),
                         _sha1(payload).alias("digest"), F.octet_length(F.coalesce(payload, F.lit(""))).alias("n"))
    leaders = (light.where(F.col("n") >= min_payload).groupBy("digest", "n")
               .agg(F.max("page_id").alias("leader"), F.count("*").alias("copies")).where(F.col("copies") > 1))
    # only payloads that repeat; a payload of a third of all pages is split by the skew join
    return (light.join(leaders, ["digest", "n"])
            .where(F.col("leader").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("leader")))
            .select("page_id", "digest", F.col("leader").alias("refers_to")).distinct())


def write_archives(pages: DataFrame, folder: str, min_payload: int = 0, ids: str = "page_id", url: str = "url",
                   payload: str = "html", null_ids: bool = True) -> DataFrame:
    """Write a record per row to archives below ``folder`` (a URI all tasks can reach); returns the
    manifest (file, bytes, records), which is kept, so nothing is written twice."""
    spark = pages.sparkSession
    prepare(spark)
    page_id = F.col(ids).cast("long")
    if not null_ids:
        page_id = F.when(F.col(ids).isNull(), F.raise_error(F.lit(f"{ids} must not be NULL"))).otherwise(page_id)
    rows = pages.select(
        page_id.alias("page_id"),
        F.col(url).cast("string").alias("url"), F.coalesce(payload, F.lit("")).alias("payload"), _sha1(payload).alias("digest"))
    revisits = decide(pages, min_payload, ids, payload).withColumnsRenamed({"page_id": "_id", "digest": "_digest"})
    rows = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left").drop("_id", "_digest")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, size, records = None, None, 0, 0
        for batch in text_slices(batches, "payload"):
            for page_id, link, text, refers_to in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")]):
                data = text.encode()
                own = payload_digest(data)
                member = gzip_member(record_bytes(page_id, link or record_name(page_id, own), data,
                                                  own, len(data), refers_to))
                if out is None:
                    name, out = open_output(folder, ".warc.gz")
                out.write(member)
                size += len(member)
                records += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "bytes": [size], "records": [records]})

    manifest = rows.mapInArrow(write, "file string, bytes long, records long")
    return written(manifest, "warc-manifest")


def _member_at(source, at: int, size: int, window: bytes, window_start: int) -> tuple[bytes, int] | None:
    """(record, end offset) of the gzip member that starts at ``at``; None when it isn't one."""
    probe = zlib.decompressobj(31)
    head = window[at - window_start:at - window_start + PROBE_BYTES]
    try:
        if not probe.decompress(head, len(VERSION)).startswith(VERSION):
            return None
        inflate, out, here = zlib.decompressobj(31), [], at
        while not inflate.eof:
            if here < window_start + len(window):
                piece = window[here - window_start:]
            else:
                source.seek(here)
                piece = source.read(min(1 << 20, size - here))
            if not piece:
                return None
            out.append(inflate.decompress(piece))
            here += len(piece)
        return b"".join(out), here - len(inflate.unused_data)
    except zlib.error:
        return None


def records_of_range(uri: str, size: int, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of the members that start in [start, stop)."""
    with open_input(uri) as source:
        source.seek(start)
        window = source.read(min(stop - start + PROBE_BYTES, size - start))  # magic at the edge included
        at = window.find(MAGIC)
        while 0 <= at < stop - start:
            got = _member_at(source, start + at, size, window, start)
            if got is None:
                at = window.find(MAGIC, at + 1)
            else:
                yield start + at, got[0]
                at = window.find(MAGIC, got[1] - start) if got[1] < stop else -1


def parse_record(data: bytes) -> dict:
    """Headers and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    number = lambda field: int(field.rpartition(":")[2].rstrip(">"))
    kind = fields["WARC-Type"]
    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
    return {"page_id": number(fields["WARC-Record-ID"]) if fields["WARC-Record-ID"].startswith("<urn:page:") else None,
            "record_type": kind,
            "refers_to": number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None,
            "url": fields["WARC-Target-URI"], "payload": payload,
            "payload_bytes": int(fields["WARC-Payload-Length"]) if payload is None else len(payload),
            "payload_digest": fields["WARC-Payload-Digest"].partition(":")[2] if payload is None else payload_digest(payload)}


def read_archives(files: DataFrame, block_bytes: int = BLOCK_BYTES, payloads: bool = True) -> DataFrame:
    """Records of the archives of a manifest (file, bytes): file, offset, page_id, record_type,
    refers_to, url, payload_bytes, payload_digest (a response's: of the payload as read; a
    revisit's: as recorded), and payload (NULL for revisits, or with ``payloads`` off)."""
    prepare(files.sparkSession)
    names = [x.strip().split()[0] for x in RECORD.split(",")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, size, start, stop in zip(*[batch.column(c).to_pylist() for c in ("file", "bytes", "start", "stop")]):
                rows, held = [], 0
                for offset, data in records_of_range(uri, size, start, stop):
                    row = parse_record(data) | {"file": uri, "offset": offset}
                    if not payloads:
                        row["payload"] = None
                    rows.append(row)
                    held += len(data)
                    if held > 16 << 20:
                        yield to_batch(rows)
                        rows, held = [], 0
                if rows:
                    yield to_batch(rows)

    def to_batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names=names)
    return byte_ranges(files.select("file", "bytes"), block_bytes).mapInArrow(read, RECORD)


def round_trip(pages: DataFrame, null_ids: bool = True) -> DataFrame:
    """Query form: write every page, read the archives back."""
    folder = shared_folder(pages.sparkSession, "warc")
    found = read_archives(write_archives(pages, folder, null_ids=null_ids), payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, max(page_id) AS leader FROM p GROUP BY html),
bits AS (SELECT page_id, strlen(p.html) AS payload_bytes, leader, upper(sha1(p.html)) AS hex
         FROM p JOIN g ON p.html = g.html),
five AS (SELECT *, list_transform(range(32), lambda i:
           instr('0123456789ABCDEF', substring(hex, ((5 * i) // 4 + 1)::INT, 1)) - 1) AS a,
         list_transform(range(32), lambda i:
           CASE WHEN (5 * i) // 4 + 2 <= 40 THEN instr('0123456789ABCDEF', substring(hex, ((5 * i) // 4 + 2)::INT, 1)) - 1 ELSE 0 END) AS b
         FROM bits)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((((a[i + 1] * 16 + b[i + 1]) >> (3 - (5 * i) % 4)::INT) & 31) + 1)::INT, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = leader THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = leader THEN NULL ELSE leader END AS refers_to
FROM five
"""
