"""DuckDB SQL that gives the same rows as the queries, where SQL can express them."""

_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

OP6 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT item_id, CAST(least(len(w), 13) AS BIGINT) AS k, array_to_string(list_slice(w, s, s + least(len(w), 13) - 1), ' ') AS t
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS s FROM i WHERE len(w) > 0)
),
lens AS (SELECT DISTINCT k FROM win),
dw AS (
  SELECT doc_id, s, k, array_to_string(list_slice(w, s, s + k - 1), ' ') AS t
  FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS s FROM d, lens)
),
hit AS (SELECT DISTINCT doc_id, s, dw.k, item_id FROM dw JOIN win ON dw.t = win.t AND dw.k = win.k),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + k - 1)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos ON pos.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id
"""

OP10 = """
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
),
win AS (
  SELECT doc_id, s, md5(array_to_string(list_slice(w, s, s + 49), ' ')) AS t
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS s FROM d)
),
low AS (SELECT t, min(doc_id) AS first_id FROM win GROUP BY t),
gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(s, s + 49)) AS p
  FROM (SELECT win.doc_id, s FROM win JOIN low ON win.t = low.t WHERE win.doc_id > low.first_id)
),
word AS (SELECT doc_id, unnest(generate_series(1, len(w))) AS p, unnest(w) AS x FROM d),
kept AS (
  SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.p) FILTER (gone.p IS NULL) AS k, count(gone.p) AS n_removed
  FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.p = word.p GROUP BY word.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

_PLAIN = "array_to_string(list_filter(regexp_split_to_array(x, '[\\x20\\x09-\\x0D]+'), lambda t: t <> ''), ' ')"

#: From the rule: a mask's places are the distinct texts that hold it; lines of which less than half is fixed recur only as
#: they stand; lines of which every word holds a digit stay; documents aren't emptied.
OP5 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS raw FROM documents),
p AS (SELECT doc_id, md5(text) AS whole, list_transform(raw, lambda x: {_PLAIN}) AS lines FROM d),
e AS (SELECT doc_id, whole, unnest(generate_series(1, len(lines))) AS i, unnest(lines) AS plain FROM p),
f AS (SELECT *, string_split(regexp_replace(plain, '(^|[ ])[^ ]*[0-9][^ ]*', '\\1<*>', 'g'), ' ') AS w FROM e WHERE plain <> ''),
g AS (SELECT *, len(w) AS n, len(list_filter(w, lambda t: t <> '<*>')) AS fixed FROM f),
l AS (
  SELECT doc_id, whole, i, w, n, 2 * fixed < n AS loose, CASE WHEN 2 * fixed < n THEN plain ELSE array_to_string(w, ' ') END AS mask, array_to_string(list_slice(w, 1, 3), ' ') AS lead
  FROM g WHERE fixed > 0
),
u AS (SELECT mask, loose, any_value(w) AS w, any_value(n) AS n, any_value(lead) AS lead, count(DISTINCT whole) AS places FROM l GROUP BY mask, loose),
t AS (SELECT mask, n, lead, places, unnest(generate_series(1, n)) AS p, unnest(w) AS tok FROM u WHERE NOT loose AND (n, lead) IN (SELECT (n, lead) FROM u WHERE NOT loose GROUP BY n, lead HAVING count(*) > 1)),
k AS (SELECT n, lead, p, tok FROM t WHERE tok <> '<*>' GROUP BY ALL HAVING sum(places) >= 10),
s AS (
  SELECT mask, any_value(t.n) AS n, count(*) AS same, string_agg(t.p || ':' || t.tok, ' ' ORDER BY t.p) AS kept, any_value(t.lead) AS lead
  FROM t JOIN k ON t.n = k.n AND t.lead = k.lead AND t.p = k.p AND t.tok = k.tok GROUP BY mask
),
nm AS (
  SELECT u.mask, u.loose, u.places, CASE WHEN 2 * s.same >= s.n THEN concat('t', s.n, '|', s.lead, '|', s.kept) ELSE concat('o', u.loose, u.mask) END AS template
  FROM u LEFT JOIN s ON NOT u.loose AND u.mask = s.mask
),
gone AS (SELECT mask, loose FROM nm WHERE template IN (SELECT template FROM nm GROUP BY template HAVING sum(places) >= 10)),
ix AS (SELECT l.doc_id, list(i) AS ix FROM l JOIN gone ON gone.mask = l.mask AND gone.loose = l.loose GROUP BY l.doc_id),
r AS (
  SELECT d.doc_id, d.text, len(raw) AS n_lines, CASE WHEN ix IS NULL THEN raw ELSE list_filter(raw, lambda x, i: NOT list_contains(ix, i)) END AS kept
  FROM d LEFT JOIN ix ON ix.doc_id = d.doc_id
),
q AS (SELECT *, len(list_filter(kept, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) = 0 AS bare FROM r)
SELECT doc_id, n_lines, CASE WHEN bare THEN 0 ELSE n_lines - len(kept) END AS n_dropped, sha256(CASE WHEN bare THEN text ELSE array_to_string(kept, chr(10)) END) AS kept_sha256
FROM q
"""

#: CRC-32 of a text of ASCII letters, bit by bit.
_CRC = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(x) + 1), lambda i: CAST(ord(x[i]) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295)"
_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE concat(strlen(CAST({0} AS VARCHAR)), ':', CAST({0} AS VARCHAR)) END"


def _leaf(text: str) -> str:
    return f"sha256(concat({', '.join(_FIELD.format(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))}))"


def _tree(name: str, levels: int) -> str:
    """Tables name1 .. and runs of each level above name0 (g, pos, h), and name_top: each group's root."""
    many = "g IN (SELECT g FROM {0} GROUP BY g HAVING count(*) > 1)"
    parts = []
    for k in range(levels):
        parts.append(f"{name}r{k} AS (SELECT g, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM {name}{k} WHERE {many.format(f'{name}{k}')} GROUP BY g, pos // 8)")
        parts.append(f"{name}{k + 1} AS (SELECT g, run AS pos, sha256(array_to_string(hs, '')) AS h FROM {name}r{k})")
    tops = " UNION ALL ".join(f"SELECT g, any_value(h) AS h FROM {name}{k} GROUP BY g HAVING count(*) = 1" for k in range(levels + 1))
    return ", ".join([*parts, f"{name}_top AS ({tops})"])


#: Levels that are written out: 8^7 documents of a language, 8^3 languages.
_INNER, _OUTER = 7, 3
_JOINS = " ".join([*(f"LEFT JOIN ar{k} ON ar{k}.g = a0.g AND ar{k}.run = a0.pos // {8 ** (k + 1)}" for k in range(_INNER)), *(f"LEFT JOIN br{k} ON br{k}.run = b0.pos // {8 ** (k + 1)}" for k in range(_OUTER))])
_STEPS = [*((f"ar{k}.hs", f"a0.pos // {8 ** k} % 8") for k in range(_INNER)), *((f"br{k}.hs", f"b0.pos // {8 ** k} % 8") for k in range(_OUTER))]
_SIDES = ", ".join(f"CASE WHEN {hs} IS NULL THEN NULL ELSE array_to_string({hs}[1:{i}], '') END AS l{n}, array_to_string({hs}[{i} + 2:], '') AS r{n}" for n, (hs, i) in enumerate(_STEPS))
_FOLDS = ", ".join(f"f{n + 1} AS (SELECT * EXCLUDE (f), CASE WHEN l{n} IS NULL THEN f ELSE sha256(concat(l{n}, f, r{n})) END AS f FROM f{n})" for n in range(len(_STEPS)))
OP12 = f"""
WITH d AS (
  SELECT *, coalesce(concat('=', lang), '-') AS g, CASE WHEN doc_id IS NOT NULL THEN {_CRC.replace('x[', 'CAST(doc_id AS VARCHAR)[').replace('length(x)', 'length(CAST(doc_id AS VARCHAR))')} % 3 = 0 ELSE false END AS picked,
    CASE WHEN text IS NOT NULL THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS low FROM documents
),
lf AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '-' ELSE g END AS g, {_leaf('text')} AS h, CASE WHEN picked AND text IS NOT NULL THEN {_leaf('low')} END AS altered FROM d),
a0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS pos FROM lf),
{_tree('a', _INNER)},
b0 AS (SELECT '' AS g, g AS lang_group, h, row_number() OVER (ORDER BY g) - 1 AS pos FROM a_top),
{_tree('b', _OUTER)},
f0 AS (SELECT a0.doc_id, a0.h AS leaf, b0.h AS subroot, (SELECT any_value(h) FROM b_top) AS root, coalesce(a0.altered, a0.h) AS f, {_SIDES} FROM a0 JOIN b0 ON b0.lang_group = a0.g {_JOINS}),
{_FOLDS}
SELECT doc_id, leaf, subroot, root, sha256(concat({', '.join(f'l{n}, r{n}' for n in range(len(_STEPS)))})) AS proof_sha256, f AS folded_root, f = root AS verified FROM f{len(_STEPS)}
"""

_KEY = "concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' '))"

#: From the rule, one row after the other: the cheapest way into each state so far, then one edit between inserts.
OP11 = f"""
WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.replace('x[', f'{_KEY}[').replace('length(x)', f'length({_KEY})')} % 20 AS kind FROM conversations),
dm AS (
  SELECT coalesce(concat('=', conv_id), '-') AS k, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM src JOIN (VALUES (0), (1)) c(n) ON kind <> 0 AND (n = 0 OR kind = 3)
),
pl AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text) AS i, role[1:1] AS ini FROM dm),
od AS (SELECT *, row_number() OVER (PARTITION BY k, role, text ORDER BY i) AS again FROM pl),
ft AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN again > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '-' END AS f,
    lag(ini) OVER (PARTITION BY k ORDER BY i) AS prior FROM od
),
st AS (
  SELECT k, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated,
    count(*) FILTER (i > 1 AND concat(prior, ini) NOT IN ('su', 'ua', 'au')) AS illegal FROM ft GROUP BY k
),
e AS (SELECT * FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) v(p, c, q)),
w AS (SELECT p, q, CASE c WHEN 'u' THEN 'user' ELSE 'assistant' END AS name FROM e WHERE c <> 's'),
c0 AS (SELECT p, p AS q, 0 AS cost, '' AS a, '' AS t FROM (VALUES (0), (1), (2), (3)) v(p)),
c1 AS (SELECT c0.p, w.q, cost + 5 AS cost, concat(a, 'I') AS a, concat(t, name, ':', chr(10)) AS t FROM c0 JOIN w ON w.p = c0.q),
c2 AS (SELECT c1.p, w.q, cost + 5 AS cost, concat(a, 'I') AS a, concat(t, name, ':', chr(10)) AS t FROM c1 JOIN w ON w.p = c1.q),
ins AS (SELECT p, q, min(struct_pack(cost := cost, a := a, t := t)) AS s FROM (SELECT * FROM c0 UNION ALL SELECT * FROM c1 UNION ALL SELECT * FROM c2) GROUP BY p, q),
ed AS MATERIALIZED (
  SELECT k, i, p, q, CASE f WHEN 't' THEN 5 ELSE 0 END AS cost, 'K' AS a, concat(role, ':', text, chr(10)) AS t FROM ft JOIN e ON e.c = ini WHERE f IN ('-', 't')
  UNION ALL SELECT k, i, p, p, CASE f WHEN 't' THEN 5 ELSE 0 END, 'K', concat(':', text, chr(10)) FROM ft, c0 WHERE f IN ('-', 't') AND ini = ''
  UNION ALL SELECT k, i, p, q, CASE f WHEN 't' THEN 6 ELSE 1 END, 'R', concat(name, ':', text, chr(10)) FROM ft, w WHERE f IN ('-', 't')
  UNION ALL SELECT k, i, p, p, 2, 'D', '' FROM ft, c0
),
r AS (
  SELECT st.k, CAST(0 AS BIGINT) AS i, ins.q, ins.s FROM st, ins WHERE ins.p = 0
  UNION ALL
  SELECT r.k, r.i + 1, ins.q, min(struct_pack(cost := r.s.cost + ed.cost + ins.s.cost, a := concat(r.s.a, ed.a, ins.s.a), t := concat(r.s.t, ed.t, ins.s.t)))
  FROM r JOIN ed ON ed.k = r.k AND ed.i = r.i + 1 AND ed.p = r.q JOIN ins ON ins.p = ed.q GROUP BY r.k, r.i, ins.q
),
best AS (SELECT r.k, min(r.s) AS s FROM r JOIN st ON st.k = r.k AND st.n = r.i WHERE r.q IN (0, 3) GROUP BY r.k)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.s.cost, 0) AS cost, coalesce(best.s.a, '') AS audit, sha256(coalesce(left(best.s.t, length(best.s.t) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(concat('=', conv_id), '-') AS k FROM conversations) c LEFT JOIN st ON st.k = c.k LEFT JOIN best ON best.k = c.k
"""

ORACLES = {"op5_line_templates": OP5, "op6_decontaminate": OP6, "op10_substrings": OP10, "op11_conversation_repair": OP11, "op12_manifest": OP12}
