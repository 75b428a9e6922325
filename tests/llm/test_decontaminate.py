import random

import pytest
from auditmill.llm import decontaminate as D


def least_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
        row = new
    return min(row)


def edited(rnd, s, n):
    s = list(s)
    for _ in range(n):
        i = rnd.randrange(len(s))
        kind = rnd.randrange(3)
        s[i : i + (kind != 1)] = [rnd.choice("abcdefgh")] * (kind != 2)
    return "".join(s)


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force(seed):
    rnd = random.Random(seed)
    prose = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 7))) for _ in range(n))
    items = [(i, prose(rnd.choice([2, 6, 8, 12, 20]))) for i in range(14)]
    texts = []
    for _ in range(60):
        t = prose(rnd.choice([0, 3, 15]))
        for _ in range(rnd.randrange(3)):
            i, item = rnd.choice(items)
            t += " " + edited(rnd, item, rnd.choice([0, 0, 1, 2, 4, 6, 9])) + " " + prose(rnd.choice([0, 4]))
        texts.append(D.normal(t))
    matcher = D.Matcher(items)
    hits = 0
    for t in texts:
        want = set()
        for i, item in items:
            k, found = D.budget(len(item)), least_edits(item, t)
            if found <= k and len(item) >= D.LEAST:
                want.add((i, found, k))
        assert set(matcher.find(t)) == want
        hits += len(want)
    assert hits > 20


def test_query_blocks_and_odd_rows(spark, monkeypatch):
    item = "The quick brown fox jumps over the lazy dog near the old river bank today"
    docs = [(1, "x. " + item.upper().replace(" ", ",\n") + " y", 0), (1, "x. " + item.upper().replace(" ", ",\n") + " y", 0), (2, None, 0), (3, "", 0), (None, item.replace("brown", "brwn"), 0), (5, "fox " * 20_000, 0), (6, "say hello you", 0), (7, "they said: good mornin, dear old Friend!", 0)]
    bench = [(10, item, 0), (11, None, 0), (12, "...", 0), (13, "Hello", 0), (14, "Good morning dear old friend", 0), (None, item + " again and again and again", 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    b = spark.createDataFrame(bench, "item_id long, text string, doc_id int")
    want = sorted([(1, 10, 0), (1, 10, 0), (None, 10, 1), (7, 14, 1)], key=str)
    for size in (10, 1_000_000):
        monkeypatch.setattr(D, "BLOCK_CHARS", size)
        assert sorted(((r.doc_id, r.item_id, r.n_edits) for r in D.find_leaks(d, b).collect()), key=str) == want
        left = D.without_leaks(d, b)
        assert left.columns == d.columns and sorted(r.doc_id for r in left.collect()) == [2, 3, 5, 6]
    assert {r.item_id for r in D.too_short(b).collect()} == {11, 12, 13}
    assert D.find_leaks(d.limit(0), b).count() == 0
    assert D.find_leaks(d, b.limit(0)).count() == 0


def test_long_items_and_bytes_that_are_no_text(spark):
    rnd = random.Random(6)
    item = " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(1500))
    docs = spark.createDataFrame([(1, "start " + edited(rnd, item, 300) + " end"), (2, edited(rnd, item, 2500)), (3, item[:4000])], "doc_id long, text string")
    docs = docs.unionByName(spark.sql("SELECT 4L AS doc_id, cast(unhex('FF61') AS string) AS text"))
    got = D.find_leaks(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 7)] and got[0].n_edits <= 300


def test_a_block_of_items_is_built_once_for_many_texts(spark, monkeypatch):
    items = [(i, f"item number {i} has some words of its own, {i * 7919}") for i in range(60)]
    texts = [(k, f"before {items[k % 60][1]} after") for k in range(300)]
    benchmark, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(D, "BLOCK_CHARS", 500)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        for gathered in (D.GATHERED, 2_000):
            monkeypatch.setattr(D, "GATHERED", gathered)
            got = sorted((r.doc_id, r.item_id) for r in D.find_leaks(docs, benchmark).collect() if r.n_edits == 0)
            assert got == [(k, k % 60) for k in range(300)]
            address, n = D._item_blocks(benchmark, D.LEAST)
            assert n > D.KEPT
            left = D.without_leaks(docs.unionByName(spark.createDataFrame([(1000, "nothing of it"), (1001, None)], "doc_id long, text string")), benchmark)
            assert sorted(r.doc_id for r in left.collect()) == [1000, 1001]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_texts_are_gathered_over_batches():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array([f"text {k} {i}" for i in range(10)])], names=["text"]) for k in range(10)]
    assert [len(b) for b, _ in D._together(iter(batches), 0, D.KEPT + 1)] == [100]
    assert [len(b) for b, _ in D._together(iter(batches), 0, D.KEPT)] == [10] * 10
    assert [t for _, texts in D._together(iter(batches), 0, D.KEPT + 1) for t in texts][:2] == [D.normal("text 0 0"), D.normal("text 0 1")]


def test_the_least_length_is_an_argument(spark):
    benchmark, docs = spark.createDataFrame([(1, "short item")], "item_id long, text string"), spark.createDataFrame([(1, "a short item here"), (2, "else")], "doc_id long, text string")
    assert D.find_leaks(docs, benchmark).count() == 0 and D.too_short(benchmark).count() == 1 and D.too_short(benchmark, 5).count() == 0
    assert [r.doc_id for r in D.find_leaks(docs, benchmark, least=5).collect()] == [1] and [r.doc_id for r in D.without_leaks(docs, benchmark, least=5).collect()] == [2]
