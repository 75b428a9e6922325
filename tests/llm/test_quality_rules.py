import random
import re

from auditmill.llm import quality_rules as Q

SPACE = re.compile("[\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    w = [x for x in SPACE.split(text) if x]
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = set()
    for i, t in enumerate(tri):
        if tri.count(t) > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if SPACE.sub("", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), sum(x in set(Q.stop_forms()) for x in w), len(hit)


def test_counts_equal_brute_force(spark):
    rnd = random.Random(5)
    texts = [None, "", " \n\t", "one", "a b c a b c", "x " * 300, "the The THE tHe the. the!! é\xa0é\x1cz", "||| ### a|b\n\n \n||| ### a|b\na"]
    for _ in range(60):
        texts.append("".join(rnd.choice(["a", "the", "b", "é🙂", "c$", "of,"]) + rnd.choice([" ", "\n", " ", "\x0b", "\t\n"]) for _ in range(rnd.randrange(80))))
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, n_words int, _words int")
    got = {r.doc_id: r for r in Q.judge(docs).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        want = brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_stop_words, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 50 or 100 * want[6] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    assert Q.judge(docs.limit(0)).count() == 0


def test_long_text_and_rules(spark):
    words = [f"w{i}" for i in range(60)]
    good = " ".join(f"the {w} of {w}x" for w in words)
    rows = [(1, good), (2, good.replace("the", "$$$$")), (3, " ".join(words)), (4, "\n".join(["the cat of a house"] * 30)), (5, " ".join(f"x{i}" for i in range(100_000))), (None, good)]
    got = {r.doc_id: r for r in Q.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].kept and got[None].kept
    assert got[2].failed == ["symbols"] and not got[2].base_failed
    assert got[3].failed == ["stop_words"]
    assert set(got[4].failed) == {"repeats", "same_lines"} and got[4].base_failed
    assert got[5].n_words == 100_000 and got[5].n_repeat_words == 0
