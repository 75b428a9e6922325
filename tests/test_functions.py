import json
import random

import pytest
from auditmill.functions import scalars as S
from auditmill.functions import udfs as U
from pyspark.sql import functions as F


def capped(s, n):
    b = s.encode()
    if n <= 0 or len(b) <= n:
        return s
    end = n
    while end > 0 and b[end - 1] & 0xC0 == 0x80:
        end -= 1
    return b[: end if end > 0 else min(n, len(b))].decode("utf-8", "replace") + "…"


@pytest.mark.parametrize("n", [0, 1, 2, 5, 32])
def test_cap_string(spark, n):
    rnd = random.Random(n)
    texts = ["", *("".join(rnd.choice("aé漢🙂") for _ in range(rnd.randrange(1, 20))) for _ in range(60))]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.cap_string(F.col("t"), n).alias("c")).collect()
    assert {r.t: r.c for r in got} == {t: capped(t, n) for t in texts}
    assert spark.sql("select cast(null as string) t").select(S.cap_string(F.col("t"), 3)).first()[0] is None


def test_json_string(spark):
    texts = ["", 'a"b\\c', "\x00\x1f\x0b\n\t\r\x08\x0c", "\\u001F", "é🙂/", "\\\\u000B\x0b", "\x7f "]
    got = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", S.json_string(F.col("t")).alias("j")).collect()
    assert {r.t: r.j for r in got} == {t: json.dumps(t, ensure_ascii=False) for t in texts} | {None: "null"}


def test_client_ip(spark):
    cases = [("1.1.1.1, 2.2.2.2", None, 0, None), ("client, proxy", None, 1, "client"), (None, " 9.9.9.9 ", 1, "9.9.9.9"), ("a,b,c", None, 2, "a"), ("a", None, 3, "a"), (" , ", "x", 1, "x"), ("a, b, c", "x", 1, "b"), (None, " ", 1, None)]
    for forwarded, real, n, want in cases:
        row = spark.createDataFrame([(forwarded, real)], "f string, r string").select(S.client_ip(F.col("f"), F.col("r"), n).alias("ip")).first()
        assert row.ip == want


def test_tenant_key(spark):
    def fnv(s):
        h = 0x811C9DC5
        u = s.encode("utf-16-be")
        for i in range(0, len(u), 2):
            h = (h ^ int.from_bytes(u[i : i + 2], "big")) * 0x01000193 & 0xFFFFFFFF
        return f"t_{h:08x}"

    want = {None: "__global__", "": "__global__", "a-B_9": "a-B_9", "../x/y": "x_y", "..": fnv(".."), "🙂": fnv("🙂"), "é/": fnv("é/"), "__a": "__a", "a" * 130: "a" * 128, "/_a_/": "a"}
    got = spark.createDataFrame([(t,) for t in want], "t string").select("t", S.tenant_key(F.col("t")).alias("k")).collect()
    assert {r.t: r.k for r in got} == want


def test_keys_and_encryption(spark):
    raw = bytes(range(32))
    assert S.normalise_key(raw) == S.normalise_key(raw.hex()) == S.normalise_key("AAECAwQFBgcICQoLDA0ODxAREhMUFRYXGBkaGxwdHh8=") == raw
    assert len(S.normalise_key("anything")) == 32
    with pytest.raises(ValueError):
        S.normalise_key("")
    df = spark.createDataFrame([("é text",), ("",)], "t string")
    made = df.select("t", S.encrypt(F.col("t"), F.lit(raw), F.lit(b"123456789012")).alias("e"))
    assert all(r.t == r.p and r.e.startswith("e1:") and r.w is None for r in made.select("t", "e", S.decrypt(F.col("e"), F.lit(raw)).alias("p"), S.decrypt(F.col("e"), F.lit(bytes(32))).alias("w")).collect())
    assert df.select(S.decrypt(F.col("t"), F.lit(raw)).alias("p")).first().p == "é text"


def test_namespace():
    assert S.namespace("a-1_B") == "a-1_B"
    for bad in ("", "a/b", "..", "x" * 65, None, "a\n"):
        with pytest.raises(ValueError):
            S.namespace(bad)


def test_shrink(spark):
    rows = [("x" * a, "y" * b, "z" * c) for a in (0, 40, 90) for b in (0, 40, 90) for c in (0, 40, 90)]
    rows = [tuple(v and f'"{v}"' or None for v in r) for r in rows]
    df = spark.createDataFrame(rows, "o string, n string, m string")
    cut = S.shrink(F.col("o"), F.col("n"), F.col("m"), 120)
    for r in df.select("o", "n", "m", *(c.alias(k) for k, c in cut.items())).collect():
        bags = {"oldValues": r.o, "newValues": r.n, "metadata": r.m}
        size = lambda: len("{" + ",".join(f'"{k}":{v}' for k, v in bags.items() if v) + "}")
        truncated = size() > 120
        for k in ("metadata", "oldValues", "newValues"):
            if size() > 120:
                bags[k] = None
        assert (r.old_values, r.new_values, r.metadata, r.truncated) == (*bags.values(), truncated)


def test_uuid7():
    ids, last = U.uuid7s(5000, ms=1_700_000_000_000)
    more, _ = U.uuid7s(10, ms=1_600_000_000_000, last=last)
    assert sorted({*ids, *more}) == ids + more
    assert ids[0][14] == "7" and ids[0][19] in "89ab" and int(ids[0].replace("-", "")[:12], 16) == 1_700_000_000_000


def test_uuid_fields_and_new_ids(spark):
    df = spark.createDataFrame([("01900000-0000-7000-8000-000000000001",), ("short",), (None,)], "i string")
    got = [tuple(r) for r in df.select(S.uuid7_ms(F.col("i")), S.uuid_version(F.col("i")), S.uuid_is_rfc(F.col("i"))).collect()]
    assert got == [(0x019000000000, 7, True), (-1, -1, False), (-1, -1, False)]
    assert spark.range(500).select(U.new_uuid7("id").alias("u")).distinct().count() == 500


def test_redaction(spark):
    bag = '{"users":[{"name":"n","password":1},{"password":2}],"password":3,"deep":{"ssn":[1,{"ssn":2}]},"items":[{"a":1},{"a":2}]}'
    row = ("t1", bag, "[1,2]", "not json", "login")
    df = spark.createDataFrame([row, (None,) * 5], "tenant_id string, old_values string, new_values string, metadata string, action string")
    got = U.redact(df, ("password", "oldValues.deep.ssn", "oldValues.items.0", "newValues.7", "", "tenantId")).collect()
    assert json.loads(got[0].old_values) == {"users": [{"name": "n"}, {}], "deep": {}, "items": [None, {"a": 2}]}
    assert (got[0].tenant_id, got[0].new_values, got[0].metadata, got[0].action) == (None, "[1,2]", "not json", "login")
    assert tuple(got[1]) == (None,) * 5
    assert U.redact(df, ("metadata",)).first().metadata is None
