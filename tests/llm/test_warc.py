import base64
import hashlib
import io

import pytest
from auditmill.llm import warc


def sha(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def brute(rows):
    first = {}
    for p, _, h in rows:
        b = (h or "").encode()
        if p is not None:
            first[b] = min(p, first.get(b, p))
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        f = first.get(b)
        revisit = f is not None and p != f
        out.append((p, len(b), sha(b), "revisit" if revisit else "response", f if revisit else None))
    return sorted(out, key=str)


ROWS = [(3, "http://x/é\r\nX: y", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "u", None), (7, "u", ""), (None, "u", "<p>é</p>"), (9, "u", "WARC/1.0\r\n\r\n" * 50), (9, "u", "WARC/1.0\r\n\r\n" * 50), (11, "u", "x" * 300_000)]


def test_round_trip(spark):
    pages = spark.createDataFrame([(*r, "q") for r in ROWS], "page_id long, url string, html string, digest string")
    assert sorted(map(tuple, warc.round_trip(pages).collect()), key=str) == brute(ROWS)
    assert warc.round_trip(pages.limit(0)).count() == 0


@pytest.mark.parametrize("split", [1, 7, 100, 1000, 10_000_000])
def test_every_split_size_reads_each_record_once(spark, split):
    made = b"".join(warc.member(i, "u", b"\x1f\x8b\x08" * i + bytes(range(256)) * (i % 3), i == 4, 1) for i in range(40))
    want = [at for at, _ in warc.records(io.BytesIO(made), 0, len(made))]
    assert len(want) == 40
    got = [at for s in range(0, len(made), split) for at, _ in warc.records(io.BytesIO(made), s, min(s + split, len(made)))]
    assert got == want


def test_payloads_and_small_ones(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    got = warc.read_archives(warc.write_archives(pages, min_bytes=3), split=50).collect()
    assert sorted((r.page_id, r.record_type, r.payload and bytes(r.payload)) for r in got) == [(1, "response", b"ab"), (2, "response", b"ab"), (3, "response", b"abc"), (4, "revisit", None)]


def test_a_damaged_record_is_an_error(spark, tmp_path):
    bad = warc.member(1, "u", b"abc", False, None).replace(b"", b"")
    import zlib

    plain = zlib.decompress(bad, 31).replace(b"\r\n\r\nabc", b"\r\n\r\nabd")
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    (tmp_path / "x").write_bytes(z.compress(plain) + z.flush())
    with pytest.raises(Exception, match="damaged"):
        warc.read_archives(spark.createDataFrame([(f"file://{tmp_path}/x", (tmp_path / "x").stat().st_size)], "path string, n_bytes long")).collect()


def _archive():
    made = [warc.member(i, "u", bytes([i]) * 50 + bytes(range(256)), False, None, 1) for i in range(5)]
    starts = [sum(map(len, made[:i])) for i in range(5)]
    data = bytearray(b"".join(made))
    return made, starts, data


@pytest.mark.parametrize("split", [1, 13, 100, 400, 10_000_000])
@pytest.mark.parametrize("place", [0, 2, 60, 150])
def test_damage_is_told_with_its_place(split, place):
    made, starts, data = _archive()
    data[starts[2] + place] ^= 0x10
    data = bytes(data[:-10])
    got = [(at, found is None) for s in range(0, len(data), split) for at, found in warc.records(io.BytesIO(data), s, min(s + split, len(data)))]
    assert [at for at, bad in got if not bad] == [starts[0], starts[1], starts[3]]
    assert [at for at, bad in got if bad] == [starts[2], starts[4]]


def test_bytes_between_and_before_records():
    made, starts, data = _archive()
    odd = b"no gzip" + made[0] + b"\0" * 20 + made[1] + b"end"
    got = [(at, found is None) for at, found in warc.records(io.BytesIO(odd), 0, len(odd))]
    assert got == [(0, True), (7, False), (7 + len(made[0]), True), (27 + len(made[0]), False), (27 + len(made[0]) + len(made[1]), True)]


def test_damage_as_rows_and_as_an_error(spark, tmp_path):
    made, starts, data = _archive()
    data[starts[2] + 60] ^= 0x10
    (tmp_path / "x").write_bytes(bytes(data[:-10]))
    files = spark.createDataFrame([(f"file://{tmp_path}/x", len(data) - 10)], "path string, n_bytes long")
    got = warc.read_archives(files, split=100, damaged=True).orderBy("start").collect()
    assert [(r.start, r.record_type, r.page_id) for r in got] == [(starts[0], "response", 0), (starts[1], "response", 1), (starts[2], "damaged", None), (starts[3], "response", 3), (starts[4], "damaged", None)]
    with pytest.raises(Exception, match=f"record at {starts[2]} is damaged"):
        warc.read_archives(files).collect()


def test_archives_of_other_writers(spark, tmp_path):
    import gzip

    record = lambda head, block: gzip.compress(("\r\n".join(["WARC/1.1", *head, f"Content-Length: {len(block)}", "", ""])).encode() + block + b"\r\n\r\n")
    data = record(["WARC-Type: warcinfo", "Content-Type: application/warc-fields"], b"software: x") + record(["WARC-Type: response", "WARC-Record-ID: <urn:uuid:1>", "Content-Type: application/http;msgtype=response"], b"HTTP/1.1 200 OK\r\n\r\nabc") + record(["WARC-Type: resource", "WARC-Payload-Digest: md5:0"], b"xy")
    (tmp_path / "x").write_bytes(data)
    got = warc.read_archives(spark.createDataFrame([(f"file://{tmp_path}/x", len(data))], "path string, n_bytes long")).orderBy("start").collect()
    assert [(r.record_type, r.page_id, r.payload_bytes, bytes(r.payload)) for r in got] == [("warcinfo", None, 11, b"software: x"), ("response", None, 3, b"abc"), ("resource", None, 2, b"xy")]
    assert got[1].payload_digest == sha(b"abc")


def test_ranges_are_dealt_to_tasks(spark):
    """With adaptive execution, which would put rows so small in one task."""
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    pages = spark.range(400).selectExpr("id AS page_id", "'u' AS url", "repeat(md5(cast(id AS string)), 50) AS html")
    files = warc.write_archives(pages)
    read = warc.read_archives(files, split=2000)
    read.count()
    at = read.selectExpr("spark_partition_id() AS p").distinct().count()
    assert at == spark.sparkContext.defaultParallelism and read.count() == 400
