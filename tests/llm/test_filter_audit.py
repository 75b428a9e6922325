from collections import Counter
from itertools import permutations

import pytest
from auditmill.llm import filter_audit as A
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, source string"


def failing(rows):
    """For each row of (doc_id, text, source) the letters that it fails."""
    out = []
    for doc, text, _ in rows:
        text = text or ""
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
        f = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text)) + "D" * any(c in "#$%&*|" for c in text)
        out.append(f + "E" * any(d is not None and doc is not None and d < doc and (t or "") == text for d, t, _ in rows))
    return out


def brute(rows, labels):
    good, toxic = ({d for d, q, x in labels if (q, x)[k] == 1 and d is not None} for k in (0, 1))
    fails, out = failing(rows), []
    for part in {s or "" for _, _, s in rows}:
        own = [(d, f) for (d, _, s), f in zip(rows, fails, strict=True) if (s or "") == part]
        found, shapley = [], Counter()
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(gone)
                found.append((part, order, step, f, len(left), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == f for x in own), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)))
        out += [(*r, shapley[r[3]]) for r in found]
    return Counter(out)


LONG = " ".join(f"word{k}" for k in range(200))
ROWS = [
    (1, LONG, "a"), (2, LONG, "a"), (3, LONG, "b"), (3, LONG, "b"), (4, "short", "a"), (5, "word " * 300, "a"), (6, LONG.upper(), "b"), (7, LONG + " #", None), (8, None, "a"), (9, "", "b"), (9, "", "b"),
    (None, LONG, "a"), (None, "ABC $", ""), (None, "ABC $", ""), (10, "x\ty\x0bz é ", "c"), (11, "éA", "c"), (12, "*" * 100_000, "c"), (13, "éA", "a"), (0, "late", "z"), (99, "late", "z"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (4, 0, 1), (4, 1, None), (6, None, 1), (13, 1, 1), (None, 1, 1), (1234, 1, 1)]


def test_equals_brute_force(spark):
    docs = spark.createDataFrame([(*r, 1, "x") for r in ROWS], SCHEMA + ", mask int, part string").withColumn("a.b", F.lit(0))
    labels = spark.createDataFrame([(*r, 5) for r in LABELS], "doc_id long, quality int, toxic int, n int")
    got = A.audit(docs, labels)
    assert Counter(tuple(r) for r in got.collect()) == brute(ROWS, LABELS)
    assert got.groupBy("part").count().where("count <> 600").count() == 0


def test_many_parts_go_together(spark, monkeypatch):
    monkeypatch.setattr(A, "TOGETHER", 3)
    rows = [(k, "t" * (k % 3) + "#" * (k % 2), f"p{k % 11}") for k in range(200)]
    docs, none = spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert Counter(tuple(r) for r in A.audit(docs, none).collect()) == brute(rows, [])


def test_a_hot_text_is_one_cell_before_it_is_shuffled_by_text(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"), F.lit("s").alias("source")).repartition(4)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {(r.mask, r.n) for r in A.cells(docs, none).collect()}
    assert got == {(1, 1), (17, 4999)}


def test_empty_and_wrong_input(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([], SCHEMA)
    assert A.audit(docs, none).count() == 0
    with pytest.raises(ValueError):
        A.audit(docs, none, ())
    with pytest.raises(ValueError):
        A.audit(docs, none, A.FILTERS[:2] + A.FILTERS[:1])


def test_other_filters(spark):
    two = (A.Filter("X", lambda text, words: F.size(words) > 1), A.Filter("Y", lambda text, words: text.contains("b")))
    docs = spark.createDataFrame([(1, "a b", "s"), (2, "b", "s"), (3, "a a", "s"), (4, "a", "s")], SCHEMA)
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in A.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), two).collect()}
    assert got == {("XY", 1): (2, 2, 0, 1, 3), ("XY", 2): (1, 1, 1, 1, 3), ("YX", 1): (2, 2, 0, 1, 3), ("YX", 2): (1, 1, 1, 1, 3)}


@pytest.mark.parametrize("n", range(1, 7))
def test_swaps_visit_every_order_once(n):
    order, seen = list(range(n)), [tuple(range(n))]
    for k in A.swaps(n):
        order[k], order[k + 1] = order[k + 1], order[k]
        seen.append(tuple(order))
    assert sorted(seen) == sorted(permutations(range(n)))
