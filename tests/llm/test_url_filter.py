import time
from itertools import combinations, product

from auditmill.llm import url_filter as U
from pyspark.sql import functions as F


def test_stated_rules_and_parts(spark):
    urls = [("http://A.Example.COM/en/x?q#f", "a.example.com", "/en/x", "example.com/en/", "block"), ("http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
            ("http://m.www.example.com/en/1", "m.www.example.com", "/en/1", "www.example.com/en/", "allow"), ("http://example.com/fr/", "example.com", "/fr/", "com/", "allow"), ("http://x.net/es/1", "x.net", "/es/1", "net/es/", "block"),
            ("http://net/fr/", "net", "/fr/", "net/fr/", "block"), ("http://badexample.com", "badexample.com", "", None, "allow"), ("http://x.org?u=http://y.net/es/", "x.org", "", None, "allow"), ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
            ("a\nb://ÀB.net/fr/#x", "Àb.net", "/fr/", "net/fr/", "block")]
    pages = spark.createDataFrame([(i, u, "z", "z") for i, (u, *_) in enumerate(urls)] + [(None, urls[0][0], "z", "z")], "page_id long, url string, host string, verdict string")
    none = spark.createDataFrame([], "url string, bad boolean")
    got = {r.page_id: tuple(r)[1:] for r in U.judge(pages, none).collect()}
    assert got == {i: tuple(x[1:]) for i, x in enumerate(urls)} | {None: tuple(urls[0][1:])}
    assert U.judge(pages.limit(0), none).count() == 0


def spelt(rules):
    """The token sets that a url must have one of."""
    return {tuple(sorted(x)) for r in rules.collect() for x in product(*r.choices)}


def own_tokens(host, path, key):
    labels = host.split(".")
    return {"host:" + ".".join(labels[i:]) for i in range(len(labels))} | {"path:" + p for p in path} | ({"key:" + key} if key else set())


def test_mined_rules_equal_brute_force(spark):
    rows, sets = [], []
    for i in range(600):
        host, path, key = f"{'ab'[i % 2]}.site{i % 3}.org", ["x", "y"][: i % 3], ["", "s", "t"][i // 7 % 3]
        t = own_tokens(host, path, key)
        bad = {"host:a.site1.org", "key:s"} <= t or ({"path:y", "key:t"} <= t and i % 10 > 0) or i % 37 == 0
        rows.append((f"http://{host}/{'/'.join(path)}" + (f"?{key}=1" if key else ""), bad))
        sets.append((t, bad))
    want = set()
    for w in (1, 2, 3):
        for c in {c for t, _ in sets for c in combinations(sorted(t), w)}:
            n = [bad for t, bad in sets if set(c) <= t]
            if sum(n) >= U.LEAST and sum(n) / len(n) >= U.CONFIDENCE:
                want.add(c)
    assert want
    labelled = spark.createDataFrame([*rows, (None, True), ("http://a.org", None)], "url string, bad boolean")
    assert spelt(U.mine(labelled)) == {c for c in want if not any(set(d) < set(c) for d in want)}
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in U.judge(pages, labelled, ()).collect()}
    assert got == {i: "block" if any(set(c) <= t for c in want) else "allow" for i, (t, _) in enumerate(sets)}


def test_rules_of_more_than_three_tokens(spark):
    parts = {"host": ("x.example.com", "y.example.com"), "path": ("en", "fr"), "first": ("page", "size"), "second": ("ref", "sort"), "third": ("lang", "tone")}
    # four tokens alone make one rule, and five another: with any of them exchanged fewer than 80 % are bad
    cases = [((0, 0, 0, 0, None), True, 40), ((1, 1, 1, 1, 1), True, 40)]
    cases += [(tuple((1 - v if k == i else v) if v is not None else None for k, v in enumerate(c)), False, 15) for c, n in ((cases[0][0], 4), (cases[1][0], 5)) for i in range(n)]
    rows, sets = [], []
    for choice, bad, n in cases:
        host, path, *keys = (None if v is None else own[v] for v, own in zip(choice, parts.values(), strict=True))
        keys = [k for k in keys if k]
        rows += [(f"http://{host}/{path}/?" + "&".join(f"{k}={i}" for k in keys), bad) for i in range(n)]
        sets += [(own_tokens(host, [path], None) | {"key:" + k for k in keys}, bad)] * n
    want = set()
    for c in {c for t in {frozenset(t) for t, _ in sets} for w in range(1, len(t) + 1) for c in combinations(sorted(t), w)}:
        n = [bad for t, bad in sets if set(c) <= t]
        if sum(n) >= U.LEAST and sum(n) / len(n) >= U.CONFIDENCE:
            want.add(c)
    least = {c for c in want if not any(set(d) < set(c) for d in want)}
    assert {len(c) for c in least} == {4, 5}
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    assert spelt(U.mine(labelled)) == least
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in U.judge(pages, labelled, ()).collect()}
    assert got == {i: "block" if bad else "allow" for i, (_, bad) in enumerate(rows)}


def test_frequent_urls_of_forty_tokens(spark):
    """Bad ones, and ones of which half are bad and no token tells which, but for a last pair."""
    long = lambda c: "http://h.org/" + "/".join(f"{c}{chr(97 + i % 26)}{'x' * (i // 26)}" for i in range(40))
    rows = [(long("b"), True)] * 60 + [(long("m"), i % 2 == 0) for i in range(200)] + [(long("m") + "?k=1&l=2", True)] * 40 + [(long("m") + "?k=1", False)] * 30 + [(long("m") + "?l=1", False)] * 30 + [("http://h.org/good", False)] * 100
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    began = time.time()
    got = {r.page_id: r.verdict for r in U.judge(spark.createDataFrame(list(enumerate(u for u, _ in rows)), "page_id long, url string"), labelled, ()).collect()}
    assert time.time() - began < 60
    assert got == {i: "block" if u == long("b") or u.endswith("?k=1&l=2") else "allow" for i, (u, _) in enumerate(rows)}


def test_more_rules_than_are_broadcast_and_hot_urls(spark, monkeypatch):
    monkeypatch.setattr(U, "BROADCAST_RULES", 0)
    rows = [("http://a.org/x?s=1", True)] * 300 + [("http://a.org/y", False)] * 100 + [(None, True)] * 200 + [("no url", True)] * 50
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in U.judge(pages, spark.createDataFrame(rows, "url string, bad boolean"), ()).collect()}
    assert got == {i: "block" if i < 300 else "allow" for i in range(len(rows))}


def test_the_sample_is_bounded(spark):
    rows = spark.range(50).selectExpr("concat('http://h.org/', id) AS url", "id % 2 = 0 AS bad")
    few = U.sample(rows, 7).collect()
    assert 5 <= len(few) <= 7 and U.sample(rows).count() == 50
    last = max(r.at for r in spark.createDataFrame(few).select(U.digest(F.col("url")).alias("at")).collect())
    assert sum(r.at < last for r in rows.select(U.digest(F.col("url")).alias("at")).collect()) == len(few) - 1


def test_a_hot_url_is_one_of_the_sample(spark):
    rows = spark.range(1000).selectExpr("if(id < 800, 'http://hot.org/', concat('http://h.org/', id)) AS url", "id % 4 > 0 AS bad").unionByName(spark.createDataFrame([(None, True), ("http://u.org", None)], "url string, bad boolean"))
    got = U.sample(rows, 200)
    assert got.where("url = 'http://hot.org/'").count() <= 1 and got.count() <= 200
    whole = {r.url: r.bad for r in U.sample(rows).collect()}
    assert len(whole) == 201 and whole["http://hot.org/"] is True
    assert "TakeOrdered" not in got._jdf.queryExecution().executedPlan().toString()


def test_rules_are_indexed_by_what_few_urls_have(spark):
    rows = [(f"http://a{i}.com/{'x' if i % 3 == 0 else 'y'}", i % 3 == 0) for i in range(150)] + [(f"http://b{i}.org/x", False) for i in range(60)]
    rules = U.mine(spark.createDataFrame(rows, "url string, bad boolean")).collect()
    assert [(sorted(map(tuple, r.choices)), r["keys"]) for r in rules] == [([("host:com",), ("path:x",)], ["path:x"])]


def test_mined_rules_decide_rows_of_the_query(spark):
    from auditmill.llm.queries import op9_url_filter

    got = op9_url_filter(spark, "/root/testdata/sf0.01").where("rule is null").groupBy("verdict").count().collect()
    assert {r.verdict for r in got} == {"allow", "block"}
