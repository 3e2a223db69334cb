"""DuckDB SQL that gives the rows of the queries by plain means, where SQL can express them."""

from __future__ import annotations

import math

from speechreport.llm.host_rules import LENIENT, LEAST_PRIOR, LINE_LIMIT, LINE_PRIOR, MIN_WORDS, REPEAT_LIMIT, STRICT, SYMBOL_LIMIT
from speechreport.llm.license_join import BLOCK, PHRASES, STATEMENT_BLOCK, STATEMENTS, TEMPLATES, THRESHOLD, block_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"'[^\x20\x09-\x0D]+'"

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT *, CASE WHEN strlen(h) >= 100 THEN min(page_id) OVER (PARTITION BY h) ELSE page_id END AS first FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM f"""


def license_sql() -> str:
    phrases = " UNION ALL ".join(
        f"SELECT doc_id, i - 1 AS spot, '{label}' AS label FROM spots WHERE " + " AND ".join(f"ws[i + {k}] = '{w}'" for k, w in enumerate(phrase.split())) for phrase, label in PHRASES.items()
    )
    rows = []
    for told, threshold, smallest in ((TEMPLATES, THRESHOLD, BLOCK), (STATEMENTS, 1.0, STATEMENT_BLOCK)):
        for label, text in told.items():
            tokens = sorted(set(text.split()))
            rows.append(f"('{label}', [{', '.join(repr(t) for t in tokens)}], {math.ceil(threshold * len(tokens) - 1e-9)}, {block_of(len(text.split()), smallest)})")
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
spots AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
base AS ({phrases}),
b AS (SELECT doc_id, count(*) AS n, min(spot) AS lo, max(spot) AS hi, list(DISTINCT label) AS labels FROM base GROUP BY 1),
t(label, tokens, need, block) AS (VALUES {', '.join(rows)}),
starts AS (SELECT doc_id, ws, block, unnest(range(0, greatest(len(ws), 1), block // 2)) AS i FROM w, (SELECT DISTINCT block FROM t)),
blocks AS (SELECT doc_id, block, list_distinct(ws[i + 1 : i + block]) AS ts FROM starts WHERE i = 0 OR i + block // 2 < len(ws)),
m AS (SELECT doc_id, label, len(list_intersect(ts, tokens)) AS c, len(tokens) AS n, need FROM blocks JOIN t USING (block)),
g AS (SELECT doc_id, list(DISTINCT label) AS labels, max(c / n) AS score FROM m WHERE c >= need GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.lo::BIGINT AS first_word, b.hi::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(g.labels, [])))), ','), '') AS labels,
  CASE WHEN b.n > 0 THEN 1.0 ELSE coalesce(g.score, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN g USING (doc_id)"""


CHAT = """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, count(*) OVER (PARTITION BY conv_id) AS n,
    '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS line FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT conv_id, place, n, string_agg(line, '') OVER (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS said FROM t),
whole AS (SELECT min(conv_id) AS conv_id, n AS n_turns, count(*) AS n_copies, said AS rendered FROM p WHERE place = n GROUP BY n, said)
SELECT * FROM whole WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.place = whole.n_turns AND p.n > p.place AND p.said = whole.rendered)"""



def jaccard_sql(words: int, percent: int, kept: str = "") -> str:
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), {WORD}) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + {words - 1}], ' ') AS x FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {words - 1}, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= {percent} * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS z FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.z),
f AS (SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(z) FROM r WHERE r.a = d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id))
SELECT *{kept} FROM f"""


JACCARD = jaccard_sql(5, 80)
MINHASH = jaccard_sql(3, 85, ", component_id = doc_id AS kept")

FILL_MIDDLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS ws, sha256('42:' || doc_id) AS h FROM documents),
u AS (SELECT *, len(ws)::BIGINT AS n, [('0x' || substr(h, 8 * k + 1, 8))::BIGINT FOR k IN range(4)] AS g FROM t),
v AS (SELECT *, least(g[1] % (n + 1), g[2] % (n + 1)) AS a, greatest(g[1] % (n + 1), g[2] % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR g[3] % 100 >= 50 THEN 'plain' WHEN g[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(ws[1 : a], '') AS p, array_to_string(ws[a + 1 : b], '') AS m, array_to_string(ws[b + 1 : n], '') AS s FROM v)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""

#: The CRC is taken byte by byte with its table of 256 entries; near words meet by what is left without one code point.
SPELLING = f"""
WITH RECURSIVE k AS (SELECT list_transform(range(256), lambda i: list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crcs),
r AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[A-Za-zÀ-ÿ]+')) AS w FROM documents) WHERE length(w) >= 7 GROUP BY 1, 2),
b AS (SELECT *, flatten([CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c) - 64] END FOR c IN string_split(doc_id || ':' || w, '')]) AS bytes FROM r),
h AS (SELECT w, n, xor(list_reduce([4294967295::BIGINT] || bytes, lambda c, x: xor(crcs[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) AS h FROM b, k),
o AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM o WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
d AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS x FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
g AS (SELECT DISTINCT d.word AS a, v.word AS b FROM d JOIN v ON d.x = v.word),
e AS (SELECT a, b FROM g UNION ALL SELECT b, a FROM g UNION ALL SELECT a.word, b.word FROM d a JOIN d b ON a.x = b.x AND a.i = b.i AND a.word <> b.word),
t AS (SELECT a, count(*) AS n_near, max(v.n) AS most FROM e JOIN v ON v.word = e.b GROUP BY 1),
f AS (SELECT a, n_near, most, min(e.b) AS best FROM t JOIN e USING (a) JOIN v ON v.word = e.b AND v.n = most GROUP BY 1, 2, 3),
s AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN most >= 10 * v.n THEN best END AS form, CASE WHEN most >= 10 * v.n THEN most END AS form_n FROM v LEFT JOIN f ON f.a = v.word),
c AS (SELECT word, form AS z, 1 AS k FROM s WHERE form IS NOT NULL UNION ALL SELECT c.word, s.form, k + 1 FROM c JOIN s ON s.word = c.z WHERE s.form IS NOT NULL),
l AS (SELECT word, arg_max(z, k) AS root FROM c GROUP BY 1)
SELECT s.word, form, coalesce(root, s.word) AS root, n, n_near, form_n FROM s LEFT JOIN l USING (word)"""

HOSTS = f"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {WORD}) AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i : i + 7], ' ') AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(8) k(k) GROUP BY 1),
lines AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT x) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM w) WHERE regexp_matches(x, {WORD}) GROUP BY 1),
m AS (SELECT w.doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(lines.dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lines.n, 0) AS n_lines
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_LIMIT} * n_words AS base_failed,
    100.0::DOUBLE * n_symbols / greatest(word_chars, 1) AS sym, 100.0::DOUBLE * n_dup_lines / (n_lines + {LINE_PRIOR}) AS lin FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed OR sym > {SYMBOL_LIMIT} OR lin > {LINE_LIMIT}) AS k FROM f GROUP BY 1),
q AS (SELECT sum(k)::DOUBLE / sum(n) AS mean, sum(k * k / n::DOUBLE) / sum(n) AS squares FROM h),
p AS (SELECT mean, least(greatest(mean * (1 - mean) / greatest(squares - mean * mean, 1e-9) - 1, {LEAST_PRIOR}), 1e6) AS weight FROM q),
v AS (SELECT source, CASE WHEN k = 0 THEN {LENIENT} ELSE least(greatest(mean / greatest((k + weight * mean) / (n + weight), 1e-9), {STRICT}), {LENIENT}) END AS scale FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (sym > {SYMBOL_LIMIT} * scale OR lin > {LINE_LIMIT} * scale) AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source"""
