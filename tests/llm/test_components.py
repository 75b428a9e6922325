import random

from auditmill.llm.components import components


def brute(edges):
    name = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(name[a], name[b])
            if name[a] != low or name[b] != low:
                name[a] = name[b] = low
                changed = True
    return set(name.items())


def test_equals_brute_force(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(120), rnd.randrange(120)) for _ in range(70)]
    edges += [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(60)] + [(-5, 2000), (7, 7)]
    rows = [*edges, edges[0], (edges[1][1], edges[1][0]), (None, 4), (4, None)]
    rnd.shuffle(rows)
    got = components(spark.createDataFrame(rows, "a long, b long"))
    assert sorted(map(tuple, got.collect())) == sorted(brute([e for e in edges if e[0] != e[1]]))


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert components(spark.createDataFrame([(3, 3)], "a long, b long")).count() == 0
