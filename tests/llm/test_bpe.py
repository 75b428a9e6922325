import hashlib
import random

import numpy as np
import pytest
import tiktoken
from auditmill.llm import bpe

PATH, PATTERN = bpe.default_tokenizer()
RANKS = bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def theirs():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_equals_the_library(theirs):
    own = bpe.Tokenizer(RANKS, PATTERN)
    rnd = random.Random(1)
    texts = ["", " ", "a" * 5000, "abc" * 900, "<|endoftext|>", "é" * 300]
    for _ in range(600):
        alphabet = rnd.choice(["abcdefgh ther", "aab", "éñß ü漢字🙂 ", "0123456789 .,\n\t\r\x1c "])
        texts.append("".join(rnd.choice(alphabet) for _ in range(rnd.choice([1, 4, 30, 300]))))
    want = [theirs.encode_ordinary(t) for t in texts]
    assert [x.tolist() for x in own.encode_all(texts)] == want
    assert [own.decode(np.array(x)) for x in want] == [t.encode() for t in texts]


def test_every_character_is_cut_alike(theirs):
    own = bpe.Tokenizer(RANKS, PATTERN)
    texts = [f"a{chr(c)} b" for c in range(0, 0x110000, 7) if not 0xD800 <= c < 0xE000]
    assert [x.tolist() for x in own.encode_all(texts)] == [theirs.encode_ordinary(t) for t in texts]


def plain(piece, ranks):
    """Merge the leftmost pair of the least rank until there is none."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts[:-1], parts[1:], strict=True)) if a + b in ranks]
        if not found:
            return tuple(ranks[p] for p in parts)
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_the_queue_merges_as_a_plain_loop_does():
    rnd = random.Random(2)
    own = bpe.Tokenizer(RANKS, PATTERN)
    # and ranks whose merges make pairs of lower rank, over several words of the bitmap
    odd = {bytes([b]): b for b in range(256)} | {b"ab": 900, b"aba": 300, b"bab": 5000, b"abab": 257, b"aa": 700, b"aaa": 256, b"ba": 901, b"aab": 10_000}
    for tok, alphabet in ((own, b"aabthern \xc3\xa9"), (bpe.Tokenizer(odd, ""), b"ab"), (bpe.Tokenizer(odd, ""), b"aab")):
        for n in [1, 2, 3, 199, 200, 1000, *(rnd.randrange(2, 60) for _ in range(300))]:
            p = bytes(rnd.choice(alphabet) for _ in range(n))
            if p not in tok.ranks:
                assert tok.merge(p) == plain(p, tok.ranks)
        assert not any(tok.words)
        # and all at once
        pieces = [p for p in (bytes(rnd.choice(alphabet) for _ in range(rnd.randrange(1, bpe.LONG))) for _ in range(400)) if p not in tok.ranks]
        flat, n = tok.merge_short(pieces)
        end = np.cumsum(n)
        assert [tuple(flat[i:j].tolist()) for i, j in zip(end - n, end, strict=True)] == [plain(p, tok.ranks) for p in pieces]


def test_first_bits():
    rnd = np.random.default_rng(4)
    for _ in range(50):
        low, begins = rnd.integers(0, 256, 40), np.unique(np.append(rnd.integers(0, 40, 6), 0))
        ends = [*begins[1:], 40]
        assert bpe._first_bits(low, begins).tolist() == [low[i:j].min() for i, j in zip(begins, ends, strict=True)]


def test_bytes_that_are_no_text_become_replacement_characters(spark):
    docs = spark.sql("SELECT 1L AS doc_id, cast(unhex('61FF62') AS string) AS text")
    assert bpe.encode_digests(docs).first().decoded_sha256 == hashlib.sha256("a\ufffdb".encode()).hexdigest()


def test_the_cache_is_emptied_when_full(monkeypatch, theirs):
    monkeypatch.setattr(bpe, "CACHE", 20)
    own = bpe.Tokenizer(RANKS, PATTERN)
    for k in range(5):
        text = " ".join(f"word{k}{i}" for i in range(30))
        assert own.encode(text) == theirs.encode_ordinary(text)


def test_digests_round_trip_and_odd_rows(spark, theirs):
    rows = [(1, "Ein Text, a text", 5), (1, "Ein Text, a text", 5), (2, None, 5), (3, "", 5), (None, "x" * 200_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted(map(tuple, bpe.encode_digests(docs).collect()), key=str)
    want = []
    for d, t, _ in rows:
        ids = theirs.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    back = bpe.decode(bpe.encode(docs))
    assert sorted((str(r.doc_id), bytes(r.bytes)) for r in back.collect()) == sorted((str(d), (t or "").encode()) for d, t, _ in rows)
    assert bpe.encode_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
