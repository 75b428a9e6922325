import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from auditmill.llm import sidefiles
from auditmill.llm.suffix_dedup import _text_hash, longest_previous_factors, previous_factors, remove_repeats, suffix_order


def brute(rows, length=100):
    seen, out = set(), []
    for d, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def made(seed, n):
    rnd = random.Random(seed)
    prose = lambda k: "".join(rnd.choice("abcdefgh éñ\n") for _ in range(k))
    passages = [prose(k) for k in (99, 100, 101, 130, 400)]
    texts = []
    for _ in range(n):
        kind = rnd.random()
        if texts and kind < 0.3:
            t = rnd.choice(texts)
        elif texts and kind < 0.5:
            t = rnd.choice(texts)
            i = rnd.randrange(len(t) + 1)
            t = t[:i] + prose(rnd.choice([1, 3])) + t[i + rnd.choice([0, 1]) :]
        else:
            t = prose(rnd.choice([0, 5, 60, 300])) + rnd.choice(passages) + prose(rnd.choice([0, 150])) + rnd.choice(passages) * rnd.choice([0, 1, 2])
        texts.append(t)
    return [(i * 3, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = [*made(seed, 80), (1000, None), (1001, ""), (1002, "ab" * 3000), (1003, "x" * 99), (1004, "x" * 99), (1005, "z" * 101)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), texts=False)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_empty_table_repeats_nulls_and_clashing_columns(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    text = "".join(chr(97 + i % 7 * (i % 5) % 26) for i in range(120))
    rows = [(5, text, 1), (5, text, 1), (None, text, 1), (7, "q" + text, 1)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, src int"))
    assert sorted((str(r.doc_id), r.n_removed, bytes(r.kept)) for r in got.collect()) == sorted([("5", 120, b""), ("5", 120, b""), ("None", 0, text.encode()), ("7", 120, b"q")])


def test_splits_planned_anew_between_scans(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sidefiles, "SLICE", 16)
    rows = made(4, 120)
    doc_id, text = zip(*rows, strict=True)
    pq.write_table(pa.table({"doc_id": pa.array(doc_id, pa.int64()), "text": text}), tmp_path / "docs.parquet", row_group_size=10)
    docs = spark.read.parquet(str(tmp_path / "docs.parquet"))
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    try:
        got = remove_repeats(docs, texts=False)
        spark.conf.set(name, "8192")
        assert got.rdd.getNumPartitions() > 3
        assert sorted(map(tuple, got.collect())) == brute(rows)
        # and from small splits to one
        got = remove_repeats(docs, texts=False)
        spark.conf.set(name, before)
        assert sorted(map(tuple, got.collect())) == brute(rows)
    finally:
        spark.conf.set(name, before)


def test_a_missing_file_of_facts_is_an_error(tmp_path):
    with pytest.raises(FileNotFoundError):
        sidefiles.load(f"file://{tmp_path}", 7)


def test_repeated_rows_far_apart_are_one_document(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sidefiles, "SLICE", 16)
    rnd = random.Random(5)
    prose = lambda k: "".join(rnd.choice("abcdefgh éñ\n") for _ in range(k))
    passage = prose(150)
    twins = [(7, passage + prose(400)), (7, prose(300) + passage), (40, passage + prose(200)), (None, prose(250)), (None, passage + prose(130))]
    big = [(1000 + i, prose(700_000)) for i in range(8)]
    # in one slice more than 2 MB apart, in other slices, and in other files
    rows = [*twins, *big[:4], *twins, *big[4:], *((2000 + i, prose(120)) for i in range(40)), *twins, (50, twins[0][1]), (51, twins[3][1])]
    for name, own in (("a", rows), ("b", [*twins, (60, passage)])):
        doc_id, text = zip(*own, strict=True)
        pq.write_table(pa.table({"doc_id": pa.array(doc_id, pa.int64()), "text": text}), tmp_path / f"{name}.parquet", row_group_size=20)
    rows += [*twins, (60, passage)]
    least = -(2**63)
    named = {(least if d is None else d, t) for d, t in rows}
    seen, want = set(), {}
    # texts with the same doc_id count as earlier by their hash
    for d, t in sorted(named, key=lambda x: (x[0], _text_hash(x[1].encode()))):
        b = t.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            w = hash(b[s : s + 100])
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        want[d, t] = bytes(x for x, g in zip(b, gone, strict=True) if not g)
    got = remove_repeats(spark.read.parquet(str(tmp_path)))
    result = sorted((least if r.doc_id is None else r.doc_id, r.n_bytes, bytes(r.kept)) for r in got.collect())
    assert result == sorted((d, len(t.encode()), want[d, t]) for d, t in ((least if d is None else d, t) for d, t in rows))
    assert any(0 < len(want[least if d is None else d, t]) < len(t.encode()) for d, t in twins)


def prefix(a, b, most):
    n = 0
    while n < most and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("letters, depth, size", [("ab", 12, 300), ("a", 20, 80), ("abc", 3, 200), ("abcdefgh", 30, 200), ("ab", 100, 400), ("ab", 8, 7)])
def test_lpf_arrays_equal_a_scan(letters, depth, size):
    rnd = random.Random(size)
    for gap in (1, 3):
        block = "".join(rnd.choice(letters) for _ in range(size // 2))
        data = (block + "".join(rnd.choice(letters) for _ in range(size // 3)) + block).encode()
        text, starts = np.frombuffer(data, np.uint8), np.arange(0, max(0, len(data) - depth + 1), gap)
        window = [data[s : s + depth] for s in starts]
        n = len(window)
        order, common = suffix_order(text, starts, depth)
        assert order.tolist() == sorted(range(n), key=lambda i: (window[i], i))
        assert common.tolist() == [prefix(window[order[r - 1]], window[order[r]], depth) if r else 0 for r in range(n)]
        lpf, psv, nsv = previous_factors(order, common)
        rank = np.argsort(order)
        for i in range(n):
            assert lpf[i] == max((prefix(window[i], window[j], depth) for j in range(i)), default=0)
            assert psv[i] == next((order[r] for r in range(rank[i] - 1, -1, -1) if order[r] < i), -1)
            assert nsv[i] == next((order[r] for r in range(rank[i] + 1, n) if order[r] < i), -1)
        assert longest_previous_factors(text, starts, depth).tolist() == lpf.tolist()


def test_texts_of_one_64_bit_hash_are_not_one_text(spark, tmp_path, monkeypatch):
    """Two texts without a string in common, whose unseeded hashes agree: a block's eight first bytes are the hash function's own constant."""
    monkeypatch.setattr(sidefiles, "SLICE", 2)
    a, b = (bytes.fromhex("b8fe6c3923a44bbe") + own * 8 + b"the rest of a text of one hundred and ten bytes, as long as the hash function's way asks for."[:94].ljust(94, b".") for own in (b"x", b"y"))
    assert len(a) == 110 and _text_hash(a) == _text_hash(b)
    for ids in ((1, 2), (3, 3), (None, None)):
        docs = spark.createDataFrame(list(zip(ids, (a, b), strict=True)), "doc_id long, text binary")
        assert [(r.n_removed, bytes(r.kept)) for r in remove_repeats(docs).orderBy("kept").collect()] == [(0, a), (0, b)]
    # repeated rows of both, in several slices
    docs = spark.createDataFrame([(i, t) for i in (None, 5) for t in (a, b, a, b, b)], "doc_id long, text binary")
    assert sorted((r.doc_id or 0, r.n_removed) for r in remove_repeats(docs).collect()) == [(0, 0)] * 5 + [(5, 110)] * 5
