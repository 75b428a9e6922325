import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from auditmill.llm import divergence as D
from pyspark.sql import functions as F


def brute(rows, least, top):
    """rows: (text, lang, source)."""
    lower = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in ((t or "", a or "", s or "") for t, a, s in rows):
        terms = [t.translate(lower) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text)]
        n[lang, source].update(terms)
        docs[lang].update(set(terms))
        groups.add((lang, source))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, d in docs[lang].items() if d >= least]
        whole = sum((n[g] for g in groups if g[0] == lang), Counter())

        def p(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}

        f = lambda a, b: (a - b) ** 2 // (a + b)
        q = p(whole)
        own = {g[1]: p(n[g]) for g in groups if g[0] == lang}
        for s, mine in own.items():
            pairs = [(sum(f(mine[t], other[t]) for t in kept), o) for o, other in own.items() if o != s]
            terms = [(f(mine[t], q[t]), t) for t in kept if n[lang, s][t] and mine[t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(found, 1) if part == "pair" or k <= top]
    return Counter(out)


ROWS = (
    [(f"alpha Beta gamma{k} été delta " * (k % 4 + 1), "en", f"s{k % 7}") for k in range(60)]
    + [("ÉTÉ Été alpha", "fr", f"s{k % 3}") for k in range(12)] + [("KK straße", None, None), ("", None, "x"), (None, "en", "s0"), ("123 --", "en", "numbers"), ("only few", "de", "a"), ("few", "de", "b"), ("same same", "en", "s1")]
    + [("same same", "en", "s1")] * 3
)


@pytest.mark.parametrize("chunk_terms, block_groups", [(1, 1), (3, 2), (D.CHUNK_TERMS, D.BLOCK_GROUPS)])
def test_equals_brute_force_in_any_tiling(spark, chunk_terms, block_groups):
    docs = spark.createDataFrame(ROWS, "text string, lang string, source string").withColumns({"term": F.lit("clash"), "n": F.lit(3), "block": F.lit(1), "a.b": F.lit(0)})
    got = D.audit(docs, least_documents=3, chunk_terms=chunk_terms, block_groups=block_groups).collect()
    assert Counter(tuple(r) for r in got) == brute(ROWS, 3, D.TOP)
    assert any(r.value == 0 and r.lang == "de" for r in got) and any(r.item == "numbers" for r in got)


def test_groups_come_from_several_tasks_and_flushes(spark, monkeypatch):
    monkeypatch.setattr(D, "HELD_TERMS", 2)
    docs = spark.createDataFrame(ROWS, "text string, lang string, source string").repartition(5)
    assert Counter(tuple(r) for r in D.audit(docs, least_documents=3, top=2).collect()) == brute(ROWS, 3, 2)


def test_long_texts_and_hot_terms(spark, monkeypatch):
    monkeypatch.setattr(D, "LONG", 50)
    rows = [("word " * 20_000 + "x" * 2_000_000, "en", "a"), ("word other", "en", "b"), ("other word", "en", "a")]
    assert Counter(tuple(r) for r in D.audit(spark.createDataFrame(rows, "text string, lang string, source string"), least_documents=1).collect()) == brute(rows, 1, D.TOP)


def test_empty_table_and_bytes_that_are_no_text(spark):
    assert D.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0
    docs = spark.sql("select cast(unhex('61FF62') as string) as text, 'en' as lang, source from values ('a'), ('b') t(source)")
    got = D.audit(docs, least_documents=1).collect()
    assert {(r.source, r.item, r.value) for r in got} == {("a", "b", 0), ("b", "a", 0)}


def test_shares_are_exact_at_large_counts(spark):
    n = [0, 1, 7, 10**9, 123_456_789_012, 2 * 10**14]
    total, terms = 28 * 10**13, 10**7
    want = [1 + 10**9 * (x + 2) // (total + 2 * terms) for x in n]
    assert D.shares(np.array(n), total, terms).tolist() == want
    rows = spark.createDataFrame([(x, total, terms) for x in n], "n long, t long, v long").coalesce(1)
    assert [r.p for r in rows.select(D.share("n", "t", "v").alias("p")).collect()] == want
