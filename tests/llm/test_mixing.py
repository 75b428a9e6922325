from collections import defaultdict
from fractions import Fraction

import pytest
from auditmill.llm import mixing as M
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, source string"


def wanted(sizes, cycle=M.CYCLE, passes=3):
    """Targets by resharing the excess until none is above; sizes: source -> words."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: Fraction(M.weight(cycle[k % len(cycle)])) for k, s in enumerate(names)}
    target, rest, open_ = {s: Fraction(0) for s in names}, Fraction(sum(sizes.values())), set(names)
    while rest and open_:
        share = rest / sum(w[s] for s in open_)
        rest = Fraction(0)
        for s in sorted(open_, key=str):
            target[s] += share * w[s]
            if target[s] >= passes * sizes[s]:
                rest += target[s] - passes * sizes[s]
                target[s] = Fraction(passes * sizes[s])
        open_ = {s for s in open_ if target[s] < passes * sizes[s]}
    return target


def held(rows):
    out = defaultdict(int)
    for _, text, source in rows:
        out[source] += len((text or "").split())
    return out


ROWS = [(k, "w " * (k % 50), f"s{k % 9}") for k in range(1500)] + [(k, "v " * 40, "small") for k in range(3)] + [(k, "x " * 300, None) for k in range(40)] + [(k, "", "empty") for k in range(5)] + [(None, None, ""), (None, "a b", ""), (7, "big " * 50_000, "zz")]


@pytest.mark.parametrize("bucket_rows, copies", [(M.BUCKET_ROWS, M.COPIES), (30, 4)])
def test_targets_are_met_and_no_row_is_taken_too_often(spark, bucket_rows, copies):
    rows = ROWS + [(5, "same row here", "s1")] * 50
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"size": F.lit(1), "part": F.lit("x"), "a.b": F.lit(2), "h": F.lit(0)})
    got = M.plan(docs, bucket_rows=bucket_rows, copies=copies).collect()
    sizes = held(rows)
    target = wanted(sizes)
    assert sorted(((r.doc_id, r.size, r.source) for r in got if r.doc_id is not None), key=str) == sorted(((d, len((t or "").split()), s) for d, t, s in rows if d is not None), key=str)
    assert len(got) == len(rows)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - float(target[r.source])) < 1e-6 * max(1, r.target)
        assert r.taken == r.size * len(r.positions) <= 3 * r.size and list(r.positions) == sorted(r.positions)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in target)
    first = [r.positions[0] for r in got if r.positions]
    assert first == sorted(first) and not any(r.positions for r in got[len(first):])
    assert all(0 <= p < sum(sizes.values()) for r in got for p in r.positions)


def test_demand_follows_the_schedules(spark):
    rows = [(k, "one two three", s) for k in range(4000) for s in ("a", "b", "c")]
    got = M.plan(spark.createDataFrame(rows, SCHEMA)).collect()
    total = 36_000
    at = {s: sorted(p / total for r in got if r.source == s for p in r.positions) for s in "abc"}
    half = {s: sum(p < 0.5 for p in own) / len(own) for s, own in at.items()}
    # integrals of the schedules up to the middle: .75 of 1, 1 of 2, 1 of 3
    assert abs(half["a"] - 0.75) < 0.01 and abs(half["b"] - 0.5) < 0.01 and abs(half["c"] - 1 / 3) < 0.01
    assert abs(len(at["c"]) / len(at["a"]) - 3) < 0.01


def test_reruns_and_other_partitions_agree(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    told = lambda docs: sorted(((r.doc_id, r.source, r.size, r.digest, tuple(r.positions)) for r in M.plan(docs, bucket_rows=100).collect()), key=str)
    assert told(rows) == told(rows.repartition(7))


def test_curriculum_has_the_texts_in_order(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (1, "other text", "x"), (2, None, "x"), (2, "", "x"), (3, "d e f g", None), (4, "h", "y")]
    docs = spark.createDataFrame(rows, SCHEMA)
    planned = M.plan(docs).collect()
    got = M.curriculum(docs).collect()
    want = sorted((p, r.doc_id, r.source or "", r.size) for r in planned for p in r.positions)
    assert sorted((r.position, r.doc_id, r.source or "", len(r.text.split())) for r in got) == want
    assert [r.position for r in got] == sorted(r.position for r in got)


def test_empty_tables_and_tables_without_words(spark):
    assert M.plan(spark.createDataFrame([], SCHEMA)).count() == 0
    got = M.plan(spark.createDataFrame([(1, None, "a"), (2, " ", None)], SCHEMA)).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2


def test_schedules(spark):
    assert [M.weight(s) for s in M.CYCLE] == [1.0, 2.0, 3.0]
    for wrong in ((), (M.Phase(0.5, 1.0),), (M.Phase(1.0, 0.0),), (M.Phase(1.0, -1.0),)):
        with pytest.raises(ValueError):
            M.weight(wrong)
    # no demand in the first half
    late = (M.Phase(0.5, 0.0), M.Phase(0.5, 2.0))
    rows = [(k, "a b", "s") for k in range(100)]
    got = M.plan(spark.createDataFrame(rows, SCHEMA), (late,)).collect()
    assert all(100 <= p < 200 for r in got for p in r.positions) and sum(r.taken for r in got) == 200
