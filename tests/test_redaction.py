"""Redaction over buffers against the same on parsed values."""

import json

import pyarrow as pa
import pytest
from auditmill.functions import redaction, udfs
from hypothesis import given, settings
from hypothesis import strategies as st


def parsed(text, keys, paths):
    try:
        value = json.loads(text)
    except ValueError:
        return text

    def without(x):
        if isinstance(x, dict):
            return {k: without(v) for k, v in x.items() if k not in keys}
        return [without(v) for v in x] if isinstance(x, list) else x

    value = without(value)
    for path in paths:
        at = value
        for name in path[:-1]:
            at = at.get(name) if isinstance(at, dict) and name else at[int(name)] if isinstance(at, list) and name.isdecimal() and int(name) < len(at) else None
        if isinstance(at, dict) and path[-1]:
            at.pop(path[-1], None)
        elif isinstance(at, list) and path[-1].isdecimal() and int(path[-1]) < len(at):
            at[int(path[-1])] = None
    return value


def run(texts, keys, paths):
    return redaction.redacted(pa.array(texts, pa.string()), keys, paths).to_pylist()


NAMES = st.sampled_from(["a", "b", "key", "0", "1", "", "é", 'q"', "\\", "x,y", "{"])
VALUES = st.recursive(st.none() | st.integers(-9, 9) | st.sampled_from(["", "a", "key", '"', "\\", '\\"', "[{", "},", "é漢"]), lambda v: st.lists(v, max_size=4) | st.dictionaries(NAMES, v, max_size=5), max_leaves=20)
TEXTS = st.builds(lambda v, ascii, gap, cut: json.dumps(v, ensure_ascii=ascii, indent=gap)[cut:], VALUES, st.booleans(), st.sampled_from([None, 1]), st.sampled_from([0, 0, 0, 0, 1]))


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXTS | st.none() | st.sampled_from(["", "{", '"', "\\", '\\"', "]}", '{"a":1,}', ',"a":1}', '{"a" "b":1}']), max_size=8), st.lists(NAMES, max_size=2, unique=True), st.lists(st.lists(NAMES, min_size=1, max_size=3), max_size=2))
def test_equals_deletion_from_parsed_values(texts, keys, paths):
    for old, new in zip(texts, run(texts, keys, paths), strict=True):
        want = None if old is None else parsed(old, keys, paths)
        if old is None or isinstance(want, str) and want == old:
            assert new == old
        else:
            assert json.loads(new) == want


def test_texts_are_told_apart_by_chunks_and_slices(monkeypatch):
    texts = [json.dumps({"n": i, "key": "x" * (i % 50), "deep": [{"key": i}]}) if i % 7 else None for i in range(300)]
    want = [t and json.dumps({"n": i, "deep": [{}]}) for i, t in enumerate(texts)]
    assert run(texts, ["key"], []) == want
    monkeypatch.setattr(redaction, "CHUNK", 64)
    assert redaction.redacted(pa.array(texts).slice(13, 200), ["key"], []).to_pylist() == want[13:213]
    assert run([], ["key"], []) == [] and run([None], ["key"], []) == [None]


def test_bytes_that_are_no_utf8_stay():
    raw = [b'{"key":"\xff"}', b'{"key":1,"b":2}', b'\x00{"key":1}', b'\xef\xbb\xbf{"key":1}']
    got = redaction.redacted(pa.array(raw, pa.binary()).view(pa.string()), ["key"], [])
    assert got.view(pa.binary()).to_pylist() == [raw[0], b'{"b":2}', *raw[2:]]


def test_what_stays_is_as_it_was_written():
    text = '{ "big": 12345678901234567890.10, "e": 1E400, "key" : {"key":1} , "u": "\\u00e9", "k\\u0065y": 2 }'
    assert run([text], ["key"], []) == ['{ "big": 12345678901234567890.10, "e": 1E400, "u": "\\u00e9"}']
    deep = '{"key":1,"a":' + "[" * 100_000 + "]" * 100_000 + "}"
    assert run([deep], ["key"], []) == [deep.replace('"key":1,', "")]


@pytest.mark.parametrize("paths", [("key",), ("metadata.a.key",), ("metadata.0.key", "metadata.1"), ("metadata.0",)])
def test_rows_that_cannot_hold_a_name_stay_out_of_python(spark, paths):
    texts = [None, "", "[1]", '{"a":{"key":1}}', '{"a":{"k\\u0065y":1}}', '{"x": 1}', '[{"key":1},2]', "not json", '"key"']
    df = spark.createDataFrame([(t, None, None) for t in texts], "metadata string, old_values string, new_values string")
    got = [r.metadata for r in udfs.redact(df, paths).collect()]
    keys, own = [p for p in paths if "." not in p], [p.split(".")[1:] for p in paths if "." in p]
    assert got == run(texts, keys, own)
    assert [t and parsed(g, [], []) for t, g in zip(texts, got, strict=True)] == [t and parsed(t, keys, own) for t in texts]
