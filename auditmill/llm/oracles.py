"""DuckDB SQL for the operators' queries that SQL can express."""

from __future__ import annotations

from auditmill.llm import chat_format, divergence, filter_audit, mixing, quality_rules, sharding, url_filter

#: The language that a page's html declares.
LANGUAGE = r'<html[^>]* lang="([A-Za-z-]+)"'
_q = lambda s: "'" + s.replace("'", "''") + "'"


def _placed(name: str, tree: list[sharding.Shard]) -> str:
    """Tables name_* of which the last, name, has the shard of each id of table s (id, key): of the accepted paths the first in time."""
    owned = [(g, n, x, w, len(own.places), own.regions) for g, own in enumerate(sharding.groups(tree)) for n, (x, w) in enumerate(own.places) if x is not None]
    places = ", ".join(f"({g}, {n}, {x}, {w!r}::DOUBLE)" for g, n, x, w, _, _ in owned)
    sizes = ", ".join(f"({g}, {c}, {r})" for g, c, r in sorted({(g, c, r) for g, _, _, _, c, r in owned}))
    k, p = sharding.RACKS, sharding.PLACES
    number = lambda a: f"('0x' || substr(h, {a}, 13))::BIGINT"
    return f"""{name}_h AS (SELECT id, g, c, r, m, md5(g || ':' || m || ':' || key) AS h FROM s, (VALUES {sizes}) z(g, c, r), range({sharding.DRAWS}) t(m)),
{name}_t AS (SELECT id, g, ((({number(14)} % r) * {k} + {number(14)} // r % {k}) * {p} + {number(14)} // (r * {k}) % {p}) AS n, ('0x' || substr(h, 27, 6))::BIGINT / 16777216.0 AS odds,
  sum(-ln(({number(1)} + 1) / 4503599627370496.0) / c) OVER (PARTITION BY id, g ORDER BY m) AS t FROM {name}_h),
{name} AS (SELECT id, arg_min(x, t) AS shard FROM {name}_t JOIN (VALUES {places}) y(g, n, x, w) USING (g, n) WHERE odds < w GROUP BY id)"""


_TREE = sharding.topology(8)
_KEY = "coalesce(doc_id::VARCHAR, '')"
# CRC-32 by bytes, with the table of its polynomial
SHARDING = f"""
WITH steps AS (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps),
d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT id, doc_id, {_KEY} AS key, (strlen(text) + 1)::BIGINT AS size, hex(encode(text)) AS x FROM d),
{_placed('now', _TREE)},
{_placed('more', sharding.grow(_TREE))},
c AS (SELECT s.* EXCLUDE (x, key), now.shard, more.shard AS grown, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)),
  lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1])), 4294967295) AS crc FROM s JOIN now USING (id) JOIN more USING (id), crc),
p AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, crc, size) - 1) // {sharding.COPIES} AS part FROM c),
b AS (SELECT *, ('0x' || substr(md5('bucket:' || {_KEY} || ':' || crc || ':' || part), 1, 13))::BIGINT % (SELECT greatest(1, ceil(count(*) / {8 * sharding.BUCKET_ROWS}.0))::BIGINT FROM documents) AS bucket FROM p)
SELECT doc_id, size, crc AS text_crc32, 'key' AS law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, crc, size, part) - 1 AS slot, grown::INT AS grown_shard FROM b
"""


def _chat() -> str:
    t = chat_format.TEMPLATE
    esc = "replace(text, '\\', '\\\\')"
    for c in t.controls:
        esc = f"replace({esc}, {_q(c)}, {_q(c[0] + chr(92) + c[1:])})"
    name = esc.replace("text", "role")
    size = f"{len(t.other.open + t.other.close + t.name_end)} + length({name}) + length({esc})"
    for role, p in t.parts.items():
        size = f"CASE WHEN role = {_q(role)} THEN {len(p.open + p.close)} + length({esc}) ELSE {size} END"
    # a role leads to one state whether it is due or not, so the state before a turn follows from the role before it
    state = lambda role: f"CASE {role} " + " ".join(f"WHEN {_q(r)} THEN {_q(s)}" for r, s in t.anyway.items()) + f" ELSE {_q(t.aside)} END"
    assert all(t.anyway[role] == to for (_, role), to in t.moves.items())
    due = " OR ".join(f"before = {_q(a)} AND role = {_q(b)}" for a, b in t.moves)
    one_of = lambda states: ", ".join(_q(s) for s in states)
    order = "turn NULLS FIRST, role, text"
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
r AS (SELECT *, row_number() OVER w - 1 AS i, lag(role) OVER w AS role_before, {state('role')} AS state FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY {order})),
m AS (SELECT * EXCLUDE role_before, CASE WHEN i = 0 THEN {_q(t.start)} ELSE {state('role_before')} END AS before FROM r),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY {order}) AS said, min(CASE WHEN NOT ({due}) THEN i END) AS late, arg_max(state, i) IN ({one_of(t.final)}) AS ends,
  coalesce(string_agg(CASE WHEN state IN ({one_of(t.learned)}) THEN text END, '' ORDER BY {order}), '') AS loss, sum({size}) + {len(t.begin)} AS chars FROM m GROUP BY conv_id),
v AS (SELECT *, coalesce(late, CASE WHEN NOT ends THEN n_turns END)::INT AS bad_turn FROM g)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, chars::BIGINT AS formatted_chars, bad_turn, bad_turn IS NULL AS valid FROM v
"""


def _bounds() -> str:
    failed = []
    for r in quality_rules.RULES:
        if not r.base:
            failed += [f"{r.measure} < {r.least}"] * (r.least is not None) + [f"{r.measure} > {r.largest}"] * (r.largest is not None)
    return " OR ".join(failed)


_FORMS = ", ".join(_q(w) for w in quality_rules.stop_forms())
QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT id, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
t AS (SELECT id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
p AS (SELECT DISTINCT id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT id, i, count(*) OVER (PARTITION BY id, t) AS c FROM t) WHERE c > 1),
r AS (SELECT id, count(*) AS n FROM p GROUP BY id),
forms AS (SELECT list([{_FORMS}]) [1] AS f),
n AS (SELECT w.id, doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(list_filter(w, lambda x: list_contains(f, x))) AS n_stop, coalesce(r.n, 0) AS n_repeat_words
  FROM w LEFT JOIN r USING (id), forms),
m AS (SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars, CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbol_ratio,
  CASE WHEN n_words > 0 THEN n_stop / n_words ELSE 0 END AS stop_ratio, CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM n)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT (base_failed OR {_bounds()}) AS kept FROM m
"""


def _urls() -> str:
    rx = "'(?s)^.*?://([^/?#]*)([^?#]*)(?:\\?([^#]*))?'"
    rules = sorted(url_filter.STATED, key=lambda r: -len(r.host + r.path))
    fits = lambda r: f"(host = {_q(r.host)} OR ends_with(host, {_q('.' + r.host)})) AND starts_with(path, {_q(r.path)})"
    pick = lambda value: "CASE " + " ".join(f"WHEN {fits(r)} THEN {_q(value(r))}" for r in rules) + " END"
    u = url_filter
    return f"""
WITH p AS (SELECT row_number() OVER () AS id, page_id, url, html, translate(coalesce(regexp_extract(url, {rx}, 1), ''), '{u._UPPER}', '{u._LOWER}') AS host, coalesce(regexp_extract(url, {rx}, 2), '') AS path, coalesce(regexp_extract(url, {rx}, 3), '') AS query FROM pages),
j AS (SELECT *, {pick(lambda r: r.host + r.path)} AS rule, {pick(lambda r: r.verdict)} AS said FROM p),
k AS (SELECT id, CASE WHEN contains(coalesce(url, ''), '://') THEN list_distinct(list_concat(
  list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: 'host:' || array_to_string(string_split(host, '.')[i:], '.')),
  list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: 'path:' || regexp_replace(x, '[0-9]+', '0', 'g')),
  list_transform(list_filter(string_split(query, '&'), lambda x: x <> ''), lambda x: 'key:' || string_split(x, '=')[1]))) ELSE [] END AS t FROM p),
tok AS (SELECT id, unnest(t) AS t FROM k),
said AS (SELECT p.id, url, nullif(regexp_extract(html, {_q(LANGUAGE)}, 1), '') AS lang FROM p),
known AS (SELECT url, min(id) AS id, sum((NOT starts_with(lower(lang), 'en'))::INT) * 2 > count(*) AS bad, ('0x' || substr(md5(url), 1, 13))::BIGINT / 4503599627370496.0 AS spot FROM said WHERE url IS NOT NULL AND lang IS NOT NULL GROUP BY url),
stepped AS (SELECT *, floor(spot * ((SELECT count(*) FROM known) / {u.LABELLED}) * {u.STEPS}) AS step FROM known),
taken AS (SELECT step, sum(count(*)) OVER (ORDER BY step) AS taken FROM stepped WHERE step < {2 * u.STEPS} GROUP BY step),
drawn AS (SELECT id, bad FROM stepped WHERE (SELECT count(*) FROM known) <= {u.LABELLED} OR step <= (SELECT max(step) FROM taken WHERE taken <= {u.LABELLED})),
lab AS (SELECT k.id, bad FROM drawn JOIN k USING (id) WHERE len(t) > 0),
m AS (SELECT greatest({u.LEAST}, ceil(count(*) * {int(u.SUPPORT * 1000)} / 1000.0)) AS least FROM lab),
c AS (SELECT lab.id, bad, a.t AS a, NULL AS b, NULL AS c FROM lab JOIN tok a USING (id)
  UNION ALL SELECT lab.id, bad, a.t, b.t, NULL FROM lab JOIN tok a USING (id) JOIN tok b ON a.id = b.id AND a.t < b.t
  UNION ALL SELECT lab.id, bad, a.t, b.t, c.t FROM lab JOIN tok a USING (id) JOIN tok b ON a.id = b.id AND a.t < b.t JOIN tok c ON b.id = c.id AND b.t < c.t),
rules AS (SELECT a, b, c FROM c GROUP BY ALL HAVING count(*) FILTER (bad) >= (SELECT least FROM m) AND count(*) FILTER (bad) / count(*) >= {u.CONFIDENCE}),
hit AS (SELECT DISTINCT k.id FROM k, rules WHERE list_contains(t, a) AND (b IS NULL OR list_contains(t, b)) AND (c IS NULL OR list_contains(t, c)))
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN hit.id IS NULL THEN 'allow' ELSE 'block' END) AS verdict FROM j LEFT JOIN hit USING (id)
"""


# an upper-case base32 digest from its hexadecimal digits: five bits at a time
WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
b AS (SELECT p.*, first, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(('0x' || substr(h, i, 1))::UTINYINT), 4, '0')), '') AS bits FROM p JOIN f USING (h))
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda g: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (list_sum(list_transform(range(5), lambda k: CASE WHEN substr(bits, g * 5 + k + 1, 1) = '1' THEN (16 >> k) ELSE 0 END)) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first IS NULL OR page_id = first THEN NULL ELSE first END AS refers_to FROM b
"""

# exact shingle sets; components by the links' closure
JACCARD = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT id, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM d),
n AS (SELECT id, doc_id, len(s) AS n FROM s),
x AS (SELECT id, unnest(s) AS t FROM s),
o AS (SELECT a.id AS a, b.id AS b, count(*) AS o FROM x a JOIN x b ON a.t = b.t AND a.id <> b.id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE 100 * o >= 80 * (p.n + q.n - o)),
r AS (SELECT id AS a, id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT doc_id, n AS n_shingles, component_id FROM n JOIN (SELECT a, min(q.doc_id) AS component_id FROM r JOIN n q ON q.id = r.b GROUP BY a) c ON c.a = n.id
"""

_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
DIVERGENCE = f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), {_LETTERS}) AS text FROM documents),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs FROM t GROUP BY ALL),
k AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY ALL HAVING sum(docs) >= {divergence.LEAST_DOCUMENTS}),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT lang, source, sum(c.n)::HUGEINT AS n FROM c JOIN k USING (lang, term) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(s.n, 0) + 2 * v.v) AS p, 1 + (1000000000::HUGEINT * (k.n + 2)) // (v.n + 2 * v.v) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN s ON s.lang = g.lang AND s.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= {divergence.TOP}
"""


def _mix() -> str:
    m, cycle = mixing, mixing.CYCLE
    x = lambda v: f"'{v!r}'::DOUBLE"
    schedule = f"((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(cycle)})::INT"
    due = ""
    for k, one in enumerate(cycle):
        own = m.pieces(one)
        line = lambda p: f"{x(p[2])} + (share - {x(p[0])}) * {x(p[3])}"
        cases = " ".join(f"WHEN share < {x(p[1])} THEN {line(p)}" for p in own[:-1])
        due += f" WHEN {k} THEN " + (f"CASE {cases} ELSE {line(own[-1])} END" if cases else line(own[-1]))
    return f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, md5(coalesce(text, '')) AS digest FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size, digest) - 1 AS i FROM d),
h AS (SELECT *, i // {m.COPIES} AS part, ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || digest || ':' || (i // {m.COPIES})), 1, 13))::BIGINT AS h FROM n),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, digest, part, i ROWS UNBOUNDED PRECEDING) - size AS start FROM h),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, list_extract([{', '.join(x(float(m.weight(s))) for s in cycle)}], {schedule} + 1) AS weight, {schedule} AS schedule, source_size * {x(float(m.PASSES))} AS full_size FROM s),
a AS (SELECT *, sum(full_size) OVER o - full_size AS fulls, sum(weight) OVER o - weight AS weights FROM w WINDOW o AS (ORDER BY full_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT max(((SELECT sum(source_size) FROM s)::DOUBLE - fulls) / ((SELECT sum(weight) FROM w) - weights)) AS level FROM a),
t AS (SELECT source, source_size, schedule, least(full_size, level * weight) AS target FROM w, l),
p AS (SELECT c.*, source_size, target, schedule, list_transform(range({m.PASSES}), lambda r: ((r * source_size + start) * 2 + size)::DOUBLE) AS middles FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, list_filter(middles, lambda y: y < target * 2) AS took, list_extract(list_filter(middles, lambda y: y < target * 2), 1) / (target * 2) AS share FROM p)
SELECT doc_id, size, source_size, target, (size * len(took))::BIGINT AS taken, floor((CASE schedule{due} END) * (SELECT sum(size) FROM d)::DOUBLE)::BIGINT AS position, len(took)::INT AS copies FROM q
"""


INTERACTIONS = """
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
o AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text),
m AS (SELECT part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text))::INT
  + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(d.doc_id > first, false)::INT AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM d JOIN o USING (text) LEFT JOIN l ON l.doc_id = d.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS b),
p AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e WHERE a.b | b.b | c.b | d.b | e.b = 31),
s AS (SELECT filter_order, i::INT AS step, f, b, coalesce((SELECT sum(x.b) FROM f x WHERE contains(substr(filter_order, 1, i - 1), x.f)), 0)::INT AS before FROM p, range(1, 6) r(i), f WHERE f = substr(filter_order, i, 1)),
r AS (SELECT part, filter_order, step, f, sum(CASE WHEN mask & (before | b) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & b <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & b <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = b THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & b <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & b <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, f AS filter, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r
"""

ORACLES = {
    "op1_hash_tree_sharding": SHARDING,
    "op3_chat_format": _chat(),
    "op5_ngram_jaccard_join": JACCARD,
    "op7_quality_rules": QUALITY,
    "op9_url_filter": _urls(),
    "op10_warc": WARC,
    "op11_source_divergence": DIVERGENCE,
    "op12_curriculum_mix": _mix(),
    "op13_filter_interactions": INTERACTIONS,
}
