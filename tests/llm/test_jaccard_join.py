import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from auditmill.llm import bytehash
from auditmill.llm.jaccard_join import SIMILARITY, _list_pairs, jaccard_components, keep_one

SPACE = " \t\n\x0b\x0c\r"


def words_of(text):
    out, word = [], ""
    for c in text or "":
        if c in SPACE:
            out, word = out + [word] * bool(word), ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    return out + [word] * bool(word)


def brute(rows):
    sets = {}
    for d, t in rows:
        w = words_of(t)
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    name = {d: d for d in sets}
    changed = True
    ids = sorted(sets)
    linked = [(x, y) for i, x in enumerate(ids) for y in ids[:i] if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])]
    while changed:
        changed = False
        for x, y in linked:
            low = min(name[x], name[y])
            if name[x] != low or name[y] != low:
                name[x] = name[y] = low
                changed = True
    return {(d, len(sets[d]), name[d]) for d in ids}


def made(seed, n):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    passage = [rnd.choice(vocabulary) for _ in range(20)]
    texts = []
    for i in range(n):
        if texts and rnd.random() < 0.6:
            w = list(rnd.choice(texts))
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
                if w:
                    w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            w = w[: len(w) - rnd.choice([0, 0, 1, 5])]
        else:
            w = [rnd.choice(vocabulary) for _ in range(rnd.choice([1, 3, 5, 9, 40, 80]))] + (passage if rnd.random() < 0.3 else [])
        texts.append(w)
    return [(i, rnd.choice(" \n\t").join(w if rnd.random() < 0.8 else [x.upper() for x in w])) for i, w in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = [*made(seed, 150), (900, None), (901, ""), (902, " \n"), (903, "É a b"), (904, "é a b"), (905, "x " * 30000)]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {tuple(r) for r in got.collect()} == brute(rows)


def test_empty_table_repeats_and_clashing_columns(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(3, "a b c d e f", 1, 2), (3, "a b c d e f", 1, 2), (2, "a b c d e f", 1, 2), (None, "a b c d e f", 1, 2), (None, None, 1, 2)]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string, set_id int, component_id int"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(3, 2, 2), (3, 2, 2), (2, 2, 2), (None, 2, 2), (None, 0, None)], key=str)


def test_words_that_collide_under_a_polynomial_stay_apart(spark):
    """A Thue-Morse word and its complement have equal polynomial hashes modulo 2**64, whatever the base."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, "a b " + word + " c d"), (4, "a b " + word.translate(str.maketrans("ab", "ba")) + " c d")]
    assert {tuple(r) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {(i, 1, i) for i in range(1, 5)}


def test_word_hashes_tell_words_apart():
    rnd = random.Random(7)
    pool = {bytes(rnd.choice(b"ab\xc3\xa9zAB") for _ in range(rnd.choice([1, 2, 7, 8, 9, 15, 16, 17, 63, 64, 65, 200]))).lower() for _ in range(4000)}
    pool = [w for w in pool if not any(c in w for c in b"\x20\x09\x0a\x0b\x0c\x0d")]
    data = np.frombuffer(b" ".join(pool + [w.upper() for w in pool]), np.uint8)
    h, first = bytehash.words(data, np.array([0, len(data)]), 5)
    assert len(h) == 2 * len(pool) == first[1] and len(set(h[: len(pool)].tolist())) == len(pool) and (h[: len(pool)] == h[len(pool) :]).all()
    assert not (bytehash.words(data, np.array([0, len(data)]), 6)[0] == h).any()


def test_thousands_of_sets_on_one_list(spark):
    """Near copies of one text, and sets that share one passage and nothing else."""
    rnd = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    rows = [(i, " ".join([*base[: 58 - i % 3], f"end{i}"])) for i in range(1500)]
    rows += [(5000 + i, " ".join([f"u{i}x{k}" for k in range(12)] + base[:9] + [f"v{i}x{k}" for k in range(rnd.choice([3, 9]))])) for i in range(1500)]
    got = {r.doc_id: r.component_id for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == {d: 0 if d < 5000 else d for d, _ in rows}


def test_one_of_each_component_with_all_columns(spark, tmp_path):
    rows = made(5, 120)
    docs = spark.createDataFrame([(d, t, d % 3, f"s{d}") for d, t in rows] + [(0, rows[0][1], 0, "s0"), (None, "only here and nowhere else at all", 1, None), (None, None, 2, None), (None, None, 2, None)], "doc_id long, text string, src int, pos string")
    want = {(d, dict(rows)[d], d % 3, f"s{d}") for d, _, c in brute(rows) if d == c} | {(None, "only here and nowhere else at all", 1, None), (None, None, 2, None)}
    got = [tuple(r) for r in keep_one(docs).collect()]
    assert len(got) == len(want) and set(got) == want
    docs.write.parquet(f"{tmp_path}/d")
    got = [tuple(r) for r in keep_one(spark.read.parquet(f"{tmp_path}/d")).collect()]
    assert len(got) == len(want) and set(got) == want


def test_long_texts_with_thousands_of_own_shingles(spark):
    base = [f"w{i}" for i in range(20_000)]
    rows = [(1, " ".join(base[:15_000] + [f"y{i}" for i in range(5_000)])), (2, " ".join(base)), (3, " ".join(base[:17_800] + [f"x{i}" for i in range(2_200)])), (4, "w1 w2 w3 w4 w5 w6")]
    assert {tuple(r) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == brute(rows)


def test_pairs_of_a_long_list_are_not_held_together():
    """3,000 sets on one list and 3 on the next: every pair comes once, and the task holds few of them at a time."""
    count = 3003
    token = np.repeat([5, 6], [count - 3, 3])
    entries = pa.RecordBatch.from_arrays([pa.array(x) for x in (token, np.arange(count), np.full(count, 50, np.int32), np.zeros(count, np.int32), np.arange(count))], names=["token", "set_id", "n", "pos", "comp"])
    tracemalloc.start()
    seen, total = np.zeros((count, count), bool), 0
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    for batch in _list_pairs(SIMILARITY)(iter([entries.slice(0, 1000), entries.slice(1000)])):
        a, b = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        assert (a < b).all()
        seen[a, b], total = True, total + len(a)
    peak = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    want = np.triu(token[:, None] == token[None, :], 1)
    assert (seen == want).all() and total == want.sum()
    assert peak < 20_000_000
