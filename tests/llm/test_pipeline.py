import hashlib
from collections import Counter

import corpus_pipeline as P
import tiktoken
from auditmill.llm import bpe
from auditmill.llm import decontaminate as D
from auditmill.llm import quality_rules as Q
from pyspark.sql import functions as F
from test_jaccard_join import brute as jaccard
from test_quality_rules import brute as counts

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def cut(rows, length=100):
    """The text left of each (doc_id, text)."""
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = t.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        out[d] = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
    return out


def good(text):
    n_words, chars, symbols, n_lines, dup, stop, repeat = counts(text)
    return n_words >= 50 and 2 * repeat <= n_words and 2.5 <= chars / n_words <= 14 and symbols <= 0.1 * n_words and stop / n_words >= 0.05 and dup / n_lines <= 0.5


def test_stages_equal_brute_force(spark, tmp_path):
    assert [r.name for r in Q.RULES] == ["words", "repeats", "word_length", "symbols", "stop_words", "same_lines"]
    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet").where("length(text) < 1200 and doc_id < 150")
    # some copies of copies, and a passage that repeats
    rows = [tuple(r) for r in docs.select(COLUMNS).collect()]
    more = [(10_000 + i, r[1] + " and then some more", *r[2:]) for i, r in enumerate(rows[:12])] + [(20_000 + i, rows[2 * i][1] + "\n" + rows[2 * i + 1][1], *rows[i][2:]) for i in range(6)]
    rows += more
    folder = tmp_path / "in"
    spark.createDataFrame(rows, docs.select(COLUMNS).schema).write.parquet(f"{folder}/documents.parquet")
    items = spark.read.parquet(f"{source}/benchmark.parquet")
    items.write.parquet(f"{folder}/benchmark.parquet")

    kept = {r[0]: r for r in rows if good(r[1])}
    first = {d for d, _, c in jaccard([(d, r[1]) for d, r in kept.items()]) if d == c}
    left = {d: t for d, t in cut([(d, kept[d][1]) for d in first]).items() if t}
    tests = [D.normal(r.text) for r in items.collect()]
    clean = {}
    for d, t in left.items():
        n = D.normal(t)
        if not any(D.distance(D.masks(i), len(i), n, D.budget(len(i))) <= D.budget(len(i)) for i in tests):
            clean[d] = t
    assert len(rows) > len(kept) > len(first) >= len(left) >= len(clean) > 20

    path, pattern = bpe.default_tokenizer()
    theirs = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    at = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, at, str(folder))
        assert k == 4 or out.columns == COLUMNS
        out.write.parquet(f"{tmp_path}/{k}")
        at = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            want = [kept, first, left, clean][k]
            assert {r.doc_id for r in at.collect()} == set(want)
        if k >= 2 and k < 4:
            assert {r.doc_id: (r.text, r.n_chars) for r in at.collect()} == {d: (t, len(t)) for d, t in want.items()}
    want = sorted((d, theirs.encode_ordinary(t), len(theirs.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()) for d, t in clean.items())
    assert sorted(map(tuple, at.collect())) == want


def test_odd_rows(spark, tmp_path):
    good_text, other = ("\n".join(f"the {c}{i}a of {c}{i}b and {c}{i}c" for i in range(30)) for c in "vw")
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, good_text, None, None, None), (2, good_text, None, None, None), (None, good_text, "en", "s", 1), (None, other, "en", "s", 1), (4, good_text + " more", "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert Counter(r.doc_id for r in P.run(spark, str(tmp_path)).collect()) == {2: 1, None: 1}
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_cuts_leave_replacement_characters_and_drop_split_ones(spark):
    one, two = ("".join(chr(97 + i * i * k % 26) for i in range(120)) for k in (3, 5))
    # in 4 the cut takes the second byte of one character and the first of another, whose rests together would be a third
    rows = [(1, one + " first"), (2, "x\ufffdy " + one + " z\ufffd"), (3, "o\u00e9" + two + "\u00e9o"), (4, "p\u0169" + two + "\u00e8q\ufffd"), (5, "a\ufffd only")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = {**dict(rows), 2: "x\ufffdy z\ufffd", 4: "pq\ufffd"}
    assert {r.doc_id: (r.text, r.n_chars) for r in P.repeated_passages(spark, docs, "").collect()} == {d: (t, len(t)) for d, t in want.items()}


def test_near_copies_of_long_texts(spark):
    """Texts that have thousands of shingles for themselves, and share four fifths with another all the same."""
    base = [f"w{i}" for i in range(20_000)]
    rows = [(7, " ".join(base), "en", "web", 1), (5, " ".join(base[:17_800] + [f"x{i}" for i in range(2_200)]), "en", "web", 2), (9, " ".join(base[:15_000] + [f"y{i}" for i in range(5_000)]), "de", "book", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(map(tuple, P.near_copies(spark, docs, "").collect())) == [rows[1], rows[2]]
