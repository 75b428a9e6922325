"""WARC: archives of gzip members, one a record, written by tasks and read by splits.

A reading task owns the records that start in its byte range. It searches the range for gzip's magic bytes and takes a place for a
member only if it decodes and begins with a WARC version line; from there, members follow one another, and the last one
is read to its end beyond the range. Magic bytes that occur inside compressed data fail that test. What should be a record and is not is
damage, which is reported with its place.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditmill.llm import sidefiles
from auditmill.llm.shared import dealt, filesystem, scratch, written

MAGIC = b"\x1f\x8b\x08"
_VERSION = b"WARC/"
#: Bytes of an archive that one task owns.
SPLIT = 16_000_000
LEVEL = 4
#: record_type of what should be a record and is not.
DAMAGED = "damaged"
_CHUNK = 1 << 16
_REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(page_id: int | None, url: str | None, payload: bytes, revisits: bool, refers_to: int | None, level: int = LEVEL) -> bytes:
    """One record as a gzip member. A revisit has the HTTP headers, which tell the payload's size, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisits else http + payload
    name = lambda i: f"<urn:page:{'none' if i is None else i}>"
    lines = ["WARC/1.0", f"WARC-Type: {'revisit' if revisits else 'response'}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    lines.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if revisits:
        lines += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: {name(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode()) + z.compress(block + b"\r\n\r\n") + z.flush()


def parse(data: bytes) -> Record:
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    return Record(headers, rest[: int(headers["content-length"])])


class _Window:
    """A file's bytes from `base` on, read as they are needed."""

    def __init__(self, f, base: int, size: int):
        self.f, self.base = f, base
        f.seek(base)
        self.data = bytearray(f.read(size))

    def more(self) -> bool:
        got = self.f.read(max(_CHUNK, 1 << 20))
        self.data += got
        return bool(got)


def _member_at(window: _Window, at: int) -> tuple[Record | None, int, bool]:
    """The record of the member that begins at a place of the window (None if there is none), where it ends, and whether its first bytes are a record's."""
    z, out, used, size, opened = zlib.decompressobj(31), [], at, 0, False
    try:
        while not z.eof:
            if used >= len(window.data) and not window.more():
                break
            chunk = bytes(window.data[used : used + _CHUNK])
            used += len(chunk)
            if made := z.decompress(chunk):
                out.append(made)
                size += len(made)
            if not opened and size >= len(_VERSION):
                if not b"".join(out).startswith(_VERSION):
                    return None, used, False
                opened = True
        return (parse(b"".join(out)) if z.eof and opened else None), used - len(z.unused_data), opened
    except (zlib.error, KeyError, ValueError):
        # an error may come before the bytes that precede it
        return None, used, opened or _begins(window, at)


def _begins(window: _Window, at: int) -> bool:
    """Whether a record's member begins at a place of the window, or the file ends there."""
    while at >= len(window.data):
        if not window.more():
            return True
    z, out, used = zlib.decompressobj(31), b"", at
    try:
        while len(out) < len(_VERSION) and not z.eof:
            if used >= len(window.data) and not window.more():
                return False
            chunk = bytes(window.data[used : used + 512])
            used += len(chunk)
            out += z.decompress(chunk, 64)
    except zlib.error:
        return False
    return out.startswith(_VERSION)


def records(f, start: int, end: int) -> Iterator[tuple[int, Record | None]]:
    """(offset, record) of each record that starts in [start, end) of an open file; None where a record is damaged.

    Damage is a member that begins as a record and can't be read to its end, and bytes that are no member where one has to begin: at the
    file's start, and after each record. Reading goes on at the next member that can be found."""
    # a member's first bytes may lie across the end
    window = _Window(f, start, end - start + len(MAGIC) - 1)
    at, due = 0, start == 0
    while at < end - start:
        if not due:
            at = window.data.find(MAGIC, at)
            if at < 0 or at >= end - start:
                return
        found, used, opened = _member_at(window, at)
        if found is None:
            if opened or due:
                yield start + at, None
            at, due = at + 1, False
        else:
            yield start + at, found
            at, due = used, True
    if due and not _begins(window, at):
        yield start + at, None


def write_archives(pages: DataFrame, min_bytes: int = 0, level: int = LEVEL) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html) into archives in the shared folder; (path, n_bytes, n_records) of each.

    The payload is html in UTF-8 (null: empty). Of records with equal payloads of min_bytes at least, that with the smallest page_id is a
    response and the others revisit it; repeated rows of it are responses. A null page_id is never the smallest unless all are null,
    and then all are responses. Equal payloads are told by size and SHA-1. A null url has no target."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html"))
    placed = sidefiles.with_source(rows, "page_id", "url", "html")
    keyed = written(placed.select("src", "pos", "page_id", F.sha1("html").alias("digest"), F.octet_length("html").alias("n")), "payloads")
    several = keyed.where(F.col("n") >= min_bytes).groupBy("digest", "n").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).where("c > 1 and first is not null")
    # a payload of thousands of pages is dealt over several tasks. The repeated side's files compress so well that they would pass for a table to broadcast
    salted = several.select("digest", "n", "first", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt")).hint("merge")
    again = keyed.withColumn("salt", F.pmod(F.xxhash64("pos"), F.lit(16)).cast("int")).join(salted, ["digest", "n", "salt"]).where(~F.col("page_id").eqNullSafe(F.col("first")))
    # no payload is shuffled: each slice's file says which of its pages revisit which
    revisits = sidefiles.save(sidefiles.packed(again.select("src", "pos", "first")), "revisits", keyed.select("src").distinct())
    address = scratch(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(address)
        fs.create_dir(path, recursive=True)
        facts = sidefiles.Facts(revisits, lambda blob: dict(np.frombuffer(blob, np.int64).reshape(-1, 2).tolist()))
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        n = size = 0
        with fs.open_output_stream(f"{path}/.{name}", compression=None) as out:
            for batch in batches:
                for page, url, html, src, pos in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                    first = facts.of(src).get(pos)
                    made = member(page, url, html.as_py(), first is not None, first, level)
                    out.write(made)
                    n, size = n + 1, size + len(made)
        if not n:
            fs.delete_file(f"{path}/.{name}")
            return
        fs.move(f"{path}/.{name}", f"{path}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([f"{address}/{name}"]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], names=["path", "n_bytes", "n_records"])

    return written(placed.select("page_id", "url", "html", "src", "pos").mapInArrow(run, "path string, n_bytes long, n_records long"), "archives")


def _page(name: str | None) -> int | None:
    if not name or not name.startswith("<urn:page:") or name == "<urn:page:none>":
        return None
    return int(name[len("<urn:page:") : -1])


RECORD = "path string, start long, record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _row(path: str, at: int, found: Record | None, payloads: bool) -> tuple:
    """A record as a row of RECORD. HTTP headers are no part of a payload; a revisit's size is the one that they state, if any."""
    if found is None:
        return (path, at, DAMAGED, *[None] * 6)
    head, payload = found
    kind, stated, size = head.get("warc-type", ""), head.get("warc-payload-digest", "").removeprefix("sha1:") or None, None
    if head.get("content-type", "").replace(" ", "").startswith("application/http"):
        http, _, payload = payload.partition(b"\r\n\r\n")
        size = next((int(x[15:]) for x in http.decode("latin-1").split("\r\n") if x.lower().startswith("content-length:") and x[15:].strip().isdigit()), None)
    page, refers = _page(head.get("warc-record-id")), _page(head.get("warc-refers-to"))
    if kind == "revisit":
        return (path, at, kind, page, head.get("warc-target-uri"), size, stated, refers, None)
    own = digest(payload)
    if (size is not None and size != len(payload)) or (stated is not None and len(stated) == 32 and stated != own):
        return (path, at, DAMAGED, *[None] * 6)
    return (path, at, kind, page, head.get("warc-target-uri"), len(payload), own, refers, payload if payloads else None)


def read_archives(files: DataFrame, split: int = SPLIT, payloads: bool = True, damaged: bool = False) -> DataFrame:
    """The records of files (path, n_bytes): path, start (offset), record_type, page_id, url, payload_bytes, payload_digest, refers_to, payload.

    Tasks own ranges of split bytes, each dealt to a task by number. A payload's digest is computed, and must be the one that its header states, if it
    states a SHA-1; a revisit's is its header's, and its payload is null. A damaged or truncated record, or bytes between records, is an error
    that names its place; with damaged, it is a row of record_type "damaged" with path and start alone. Records of other
    writers have no page_id. Empty files have no records. Null paths are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, end in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                fs, local = filesystem(path)
                rows: list = []
                with fs.open_input_file(local) as f:
                    for at, found in records(f, start, end):
                        row = _row(path, at, found, payloads)
                        if row[2] == DAMAGED and not damaged:
                            raise ValueError(f"{path}: the record at {at} is damaged")
                        rows.append(row)
                        if len(rows) >= 500:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    held = files.where("path is not null and n_bytes > 0")
    owned = held.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bytes") - 1, F.lit(split).cast("long"))).alias("start"), "n_bytes")
    ranges = owned.select("path", "start", F.least(F.col("start") + split, "n_bytes").alias("end"))
    n, total = held.agg(F.sum(F.ceil(F.col("n_bytes") / split)), F.sum("n_bytes")).first()
    return dealt(ranges, n or 0, total or 0).mapInArrow(run, RECORD)


def _batch(rows: list) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each row of pages, written to archives and read back.

    Odd rows are as write_archives() says. An empty table gives no rows."""
    return read_archives(write_archives(pages).select("path", "n_bytes"), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
