"""WARC writing, and reading with boundary-chain verification.

Archives are unindexed.  Tasks scan blocks for whatever looks like the start of a record and emit, for each
candidate, the place where its successor would start; inside a block these links are followed at once, so a
candidate points to the first record behind the block.  Pointer jumping from each file's start then finds
the one place where the true chain enters every block, in log2(blocks) rounds, and only records on that
chain are read.  Magic inside a payload is a candidate that nothing on the chain leads to.

Two framings: plain records (``WARC/1.1`` and Content-Length) and one gzip member for each record, whose
header's extra field ``sl`` holds the compressed length.

Defined cases: a null html is an empty payload; equal payloads of MIN_REVISIT bytes or more are stored once,
by the row with the largest page_id (rows that repeat this page_id and payload are responses too; payloads
whose rows have no page_id are all responses); a null url is left out; an empty table gives an empty result;
further columns of the input, whatever their names, are ignored; a page_id that isn't an integer is refused; a
payload of any length is one record.  A file that doesn't begin with a record, or whose chain breaks off before
its end, is an error.  Reading knows the two framings above and no others (in a gzip file, members without ``sl``
are such an error).
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, arrow_map, durable, filled, integer_id, shared_folder
from .files import Ranges, blocks, published, task_count

MIN_REVISIT = 1000
BLOCK_BYTES = 2 << 20
#: A group of equal payloads takes so many bytes at most: 40 of the digest, 8 of the number, and what a row adds.
GROUP_BYTES = 96
HEADER_BYTES = 64 << 10
#: Records that a reading task gives out at a time.
READ_ROWS = 10_000
PLAIN, GZIP = b"WARC/1.1\r\n", b"\x1f\x8b\x08\x04\0\0\0\0\x02\xff\x0c\0sl\x08\0"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(x: str) -> str:
    return re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", x)


def record(page_id, url, payload: bytes, sha1: bytes, size: int, refers_to, day: str = "2024-01-01T00:00:00Z") -> bytes:
    """A response record, or a revisit of ``refers_to`` without its payload."""
    digest = base64.b32encode(sha1).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {day}",
        *([f"WARC-Target-URI: {_line(url)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member with both lengths in its header."""
    squeezed = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = squeezed.compress(data) + squeezed.flush()
    size = len(GZIP) + 8 + len(body) + 8
    return GZIP + struct.pack("<II", size, len(data)) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def successor(data: bytes, at: int, packed: bool) -> int | None:
    """How many bytes the record that starts at data[at] takes, if one does."""
    if packed:
        if data[at : at + len(GZIP)] != GZIP or len(data) < at + len(GZIP) + 8:
            return None
        size = struct.unpack_from("<I", data, at + len(GZIP))[0]
        return size if size > len(GZIP) + 16 else None
    if data[at : at + len(PLAIN)] != PLAIN or (end := data.find(b"\r\n\r\n", at, at + HEADER_BYTES)) < 0:
        return None
    m = re.search(rb"\r\nContent-Length:[ \t]*(\d{1,18})\r\n", data[at : end + 2], re.I)
    return end + 4 - at + int(m[1]) + 4 if m else None


def write_archives(pages: DataFrame, packed: bool = True) -> DataFrame:
    """One archive for each partition; returns (file, uri, length)."""
    base = pages.select(integer_id(pages, "page_id"), F.col("url").cast("string").alias("url"), filled("html").alias("html"))
    base = base.withColumn("sha1", F.sha1(F.encode("html", "UTF-8")))
    equal = (
        base.where(F.octet_length("html") >= MIN_REVISIT).groupBy("sha1")
        .agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("first")).where("n > 1 and first is not null").select("sha1", "first")
    )
    # written: so its size is known, and a join by shuffle can split a very large group of pages over tasks
    equal = durable(equal)
    if equal.count() * GROUP_BYTES <= BROADCAST_BYTES:
        equal = F.broadcast(equal)
    rows = base.join(equal, "sha1", "left").select(
        "page_id", "url", "html", "sha1",
        F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"),
    )
    folder = shared_folder(pages.sparkSession, "warc")

    def run(batches):
        n = TaskContext.get().partitionId()
        uri, length = f"{folder}/{n:06d}.warc{'.gz' * packed}", 0
        with published(uri) as out:
            for batch in batches:
                for page_id, url, html, sha1, refers_to in zip(*(c for c in batch.columns), strict=True):
                    payload = html.cast(pa.binary()).as_py()
                    data = record(page_id.as_py(), url.as_py(), payload, bytes.fromhex(sha1.as_py()), len(payload), refers_to.as_py())
                    data = member(data) if packed else data
                    out.write(data)
                    length += len(data)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([uri]), pa.array([length])], ["file", "uri", "length"])

    return durable(arrow_map(rows, run, "file long, uri string, length long"))


def candidates(files: DataFrame, packed: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, block, offset, exit): what looks like a record, and where its chain leaves the block."""
    magic = GZIP if packed else PLAIN

    def search(batches):
        source = Ranges()
        for batch in batches:
            for file, uri, length, block, offset in zip(*(batch.column(c).to_pylist() for c in ("file", "uri", "length", "block", "offset")), strict=True):
                data = source.read(uri, offset, block_bytes + HEADER_BYTES)
                stop, at, found = min(block_bytes, len(data)), data.find(magic), []
                while 0 <= at < stop:
                    size = successor(data, at, packed)
                    if size is not None and offset + at + size <= length:
                        found.append((at, at + size))
                    at = data.find(magic, at + 1)
                leaves: dict[int, int] = {}
                for at, to in reversed(found):
                    if to >= stop or to in leaves:  # else it leads to what is no record: no true chain does
                        leaves[at] = to if to >= stop else leaves[to]
                at = np.array(sorted(leaves), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), file)), pa.array(np.full(len(at), block)), pa.array(at + offset), pa.array(np.array([leaves[a] for a in at.tolist()], np.int64) + offset)],
                    ["file", "block", "offset", "exit"],
                )

    return arrow_map(blocks(files, block_bytes), search, "file long, block long, offset long, exit long")


def entries(files: DataFrame, found: DataFrame) -> DataFrame:
    """(file, offset): where the chain from each file's start enters its blocks, by pointer jumping."""
    # candidates grow with the archives, whatever the plan estimates: merge joins, no broadcast
    jumps = found.select("file", "offset", "exit").hint("merge")
    reached = files.where("length > 0").select("file", F.lit(0).cast("long").alias("offset"))
    furthest = found.agg(F.max("block")).first()[0] or 0
    for _ in range(int(furthest).bit_length()):
        step = reached.join(jumps, ["file", "offset"]).select("file", F.col("exit").alias("offset"))
        reached = durable(reached.union(step).distinct())
        onward = jumps.select("file", F.col("offset").alias("exit"), F.col("exit").alias("next"))
        jumps = durable(
            jumps.join(onward.hint("merge"), ["file", "exit"], "left").select("file", "offset", F.coalesce("next", "exit").alias("exit"))
        ).hint("merge")
    return reached


def read_archives(files: DataFrame, packed: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every record on the chain: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    found = durable(candidates(files, packed, block_bytes))
    headless = files.where("length > 0").join(found.where("offset = 0").select("file").hint("merge"), "file", "left_anti")
    if (bad := headless.select("uri").first()) is not None:
        raise ValueError(f"{bad[0]} doesn't begin with a record of this framing")
    starts = entries(files, found).join(found.hint("merge"), ["file", "offset"], "left_semi").join(files, "file")

    def table(rows):
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)], NAMES)

    def read(batches):
        source = Ranges()
        for batch in batches:
            rows = []
            for uri, length, at in zip(*(batch.column(c).to_pylist() for c in ("uri", "length", "offset")), strict=True):
                upto = min(length, (at // block_bytes + 1) * block_bytes)
                data, base = source.read(uri, at, upto - at), at
                while at < upto:
                    if (size := successor(data, at - base, packed)) is None or at - base + size > len(data):
                        data, base = source.read(uri, at, max(HEADER_BYTES, size or 0)), at
                        size = successor(data, 0, packed)
                        if size is None or at + size > length:
                            raise ValueError(f"no record at {at} of {uri}")
                        if size > len(data):
                            data = source.read(uri, at, size)
                    raw = data[at - base : at - base + size]
                    rows.append(parse(zlib.decompress(raw, 31) if packed else raw))
                    at += size
                    if len(rows) >= READ_ROWS:
                        yield table(rows)
                        rows = []
            yield table(rows)

    # a number is given, as the offsets are so few bytes that adaptive execution would read all records in one task
    dealt = starts.select("uri", "length", "offset").repartition(task_count(files, block_bytes), "uri", "offset")
    return arrow_map(dealt, read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


NAMES = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]


def parse(data: bytes) -> tuple:
    """A record's row; a response's payload is measured and hashed, a revisit's header says both."""
    head, _, rest = data.partition(b"\r\n\r\n")
    field = {k.lower(): v for k, v in (x.split(b": ", 1) for x in head.split(b"\r\n")[1:])}
    http, _, tail = rest[: int(field[b"content-length"])].partition(b"\r\n\r\n")
    page = lambda x: int(m[1]) if (m := re.fullmatch(rb"<urn:page:(-?\d+)>", x)) else None
    stated = base64.b32decode(field[b"warc-payload-digest"].removeprefix(b"sha1:")).hex()
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    if field[b"warc-type"] == b"revisit":
        return page(field[b"warc-record-id"]), size, stated, "revisit", page(field[b"warc-refers-to"])
    digest = hashlib.sha1(tail).hexdigest()
    if len(tail) != size or digest != stated:
        raise ValueError("a payload differs from its header")
    return page(field[b"warc-record-id"]), size, digest, "response", None


def round_trip(pages: DataFrame, packed: bool = False) -> DataFrame:
    """Write archives and read them back; plain records, so that payloads that hold records' magic are met."""
    return read_archives(write_archives(pages, packed), packed)


SQL = f"""
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html)::bigint as n, sha1(html) as digest from p),
r as (select *, max(page_id) over (partition by digest) as last from d)
select page_id, n as payload_bytes, digest as payload_digest,
       case when n >= {MIN_REVISIT} and page_id <> last then 'revisit' else 'response' end as record_type,
       case when n >= {MIN_REVISIT} and page_id <> last then last end as refers_to
from r
"""
