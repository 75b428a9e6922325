import time
import zlib
from collections import Counter

import pytest
from auditmill.llm import sharding as S
from pyspark.sql import functions as F


def test_law_slots_and_checksums(spark):
    rows = [(i, f"text {i}" * (i % 5), 1, 2) for i in range(3000)] + [(None, None, 1, 2), (None, "é", 1, 2), (7, "text 7text 7", 1, 2)]
    got = S.assign(spark.createDataFrame(rows, "doc_id long, text string, shard int, slot int")).collect()
    assert len(got) == len(rows)
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _, _ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(r.grown_shard in (r.shard, 8) for r in got)
    assert len({(r.doc_id, r.shard, r.grown_shard) for r in got}) == 3001
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(8)) and max(counts.values()) < 1.4 * min(counts.values())
    assert 200 < sum(r.grown_shard == 8 for r in got) < 500
    assert S.assign(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_weights_and_movement(spark):
    tree = [S.Shard("a", "a1", 0, 1), S.Shard("a", "a1", 1, 3), S.Shard("a", "a2", 2, 2), S.Shard("b", "b1", 3, 2)]
    heavier = [*tree[:2], S.Shard("a", "a2", 2, 4), tree[3]]
    keys = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    got = keys.select(S.place(F.col("k"), tree, unit=4).alias("x"), S.place(F.col("k"), heavier, unit=4).alias("y"), S.place(F.col("k"), S.grow(tree, 2), unit=4).alias("z")).collect()
    share = Counter(r.x for r in got)
    for s, w in enumerate((1, 3, 2, 2)):
        assert abs(share[s] / 20_000 - w / 8) < 0.02
    # a heavier shard takes rows from anywhere, and none move between others
    assert all(r.y in (r.x, 2) for r in got) and any(r.y != r.x for r in got)
    assert all(r.z in (r.x, 4) for r in got)
    with pytest.raises(ValueError):
        S.place(F.col("k"), [])
    with pytest.raises(ValueError):
        S.place(F.col("k"), [S.Shard("a", "a", 0, 0)])
    with pytest.raises(ValueError):
        S.place(F.col("k"), heavier)
    with pytest.raises(ValueError):
        S.place(F.col("k"), [S.Shard("a", f"k{i}", i) for i in range(3)])


def test_movement_is_confined_to_the_subtree_that_changes(spark):
    """A region with three shards comes and goes: rows move into it, and back, alone; within it they go by weight."""
    tree = [*S.topology(6), S.Shard("far", "f1", 6), S.Shard("far", "f1", 7, 0.5), S.Shard("far", "f2", 8)]
    keys = spark.range(8000).select(F.col("id").cast("string").alias("k"))
    got = keys.select(S.place(F.col("k"), tree[:6]).alias("x"), S.place(F.col("k"), tree).alias("y")).collect()
    assert all(r.y == r.x or r.y > 5 for r in got)
    n = Counter(r.y for r in got)
    assert all(abs(n[x.shard] / 8000 - x.weight / 8.5) < 0.02 for x in tree)


def test_a_thousand_shards(spark):
    began = time.time()
    tree = S.topology(1000)
    got = spark.range(4000).select(S.place(F.col("id").cast("string"), tree).alias("x"), S.place(F.col("id").cast("string"), S.grow(tree)).alias("y")).collect()
    assert time.time() - began < 90
    assert all(r.y in (r.x, 1000) for r in got) and len({r.x for r in got}) > 900 and max(Counter(r.x for r in got).values()) < 20


def test_rows_that_no_path_leads_to_a_shard(spark):
    """With one path each group often finds none: the draw of all shards decides, and the law still holds."""
    tree = [S.Shard("a", "a1", 0, 0.1), S.Shard("b", "b1", 1, 0.1)]
    got = spark.range(3000).select(S.place(F.col("id").cast("string"), tree, draws=1).alias("x"), S.place(F.col("id").cast("string"), [*tree, S.Shard("b", "b2", 2, 0.3)], draws=1).alias("y")).collect()
    assert all(r.y in (r.x, 2) for r in got) and {r.x for r in got} == {0, 1}


def test_one_place_for_each_id_and_number_of_shards(spark):
    keys = spark.range(3000).select(F.col("id").cast("string").alias("k"))
    at = [[r.s for r in keys.select(S.place(F.col("k"), S.topology(n)).alias("s")).collect()] for n in range(1, 22)]
    for n in range(1, 21):
        before, after = at[n - 1], at[n]
        assert S.grow(S.topology(n)) == S.topology(n + 1)
        assert all(b in (a, n) for a, b in zip(before, after, strict=True))
        assert abs(sum(b == n for b in after) - 3000 / (n + 1)) < 5 * (3000 / (n + 1)) ** 0.5
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    for n in (1, 2, 5, 8, 12):
        grown = {r.doc_id: r.grown_shard for r in S.assign(docs, n).collect()}
        assert grown == {r.doc_id: r.shard for r in S.assign(docs, n + 1).collect()}


def test_hot_rows_long_texts_and_many_buckets(spark):
    rows = [(5, "same")] * 500 + [(None, "same")] * 300 + [(None, f"t{i}") for i in range(200)] + [(9, "x" * 3_000_000)]
    got = S.assign(spark.createDataFrame(rows, "doc_id long, text string"), 3, bucket_rows=20, copies=7).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, len(t) + 1) for d, t in rows)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
