"""DuckDB SQL for the operators whose results SQL can express."""

from __future__ import annotations

from sparqa.llm import license

_WS = r"[ \t\n\x0b\x0c\r]"
_WORDS = r"[^ \t\n\x0b\x0c\r]+"


def _license_sql() -> str:
    """The rule of the operator: lines that state a copyright are blank, known digests come from the same table of texts."""
    first: dict[str, str] = {}
    for i, t in (*license.KNOWN, *license.full_texts()):
        d = license.digest_of(t)
        if d is not None:
            first[d] = min(first.get(d, i), i)
    look = ", ".join(f"('{d}', '{i}')" for d, i in sorted(first.items()))
    mark = r"^[ \t]*(?:copyright|\(c\)|©)[ \t:]+"
    notice = (rf"(regexp_matches(x, '{license.DATED_LINE}') OR (regexp_matches(x, '{mark}(?:\S+[ \t]+){{0,7}}\S*[^\s,;:][ \t\r]*$')"
              rf" AND NOT regexp_matches(regexp_replace(x, '{mark}', ''), '\b(?:{license._SENTENCE})\b')))")
    plain = rf"list_transform(string_split(lower(coalesce(text, '')), chr(10)), lambda x: CASE WHEN {notice} THEN '' ELSE trim(regexp_replace(x, '[^\p{{L}}\p{{N}}]+', ' ', 'g')) END)"
    spelled = "concat(' ', replace(p, ' ', '  '), ' ')"
    for a, b in license.SPELLINGS:
        spelled = f"replace({spelled}, ' {a.replace(' ', '  ')} ', ' {b.replace(' ', '  ')} ')"
    return f"""
WITH look(digest, license_id) AS (VALUES {look}),
l AS (SELECT doc_id, {plain} AS ls FROM documents),
u AS (SELECT doc_id, 'text' AS unit, CAST(-1 AS INTEGER) AS position, array_to_string(list_filter(ls, lambda x: x <> ''), ' ') AS p FROM l
      UNION ALL SELECT * FROM (SELECT doc_id, 'line' AS unit, CAST(unnest(range(len(ls))) AS INTEGER) AS position, unnest(ls) AS p FROM l) WHERE p <> ''),
d AS (SELECT doc_id, unit, position, CASE WHEN p <> '' THEN sha256(trim(replace({spelled}, '  ', ' '))) END AS digest FROM u)
SELECT doc_id, unit, position, d.digest, license_id FROM d LEFT JOIN look ON look.digest = d.digest WHERE unit = 'text' OR license_id IS NOT NULL
"""


#: crc32 of a text ``x``, unsigned: its 256-entry table made by rule, then one step a byte.
_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i))"


def _crc32(x: str, table: str) -> str:
    codes = f"list_transform(range(octet_length(encode({x}))), lambda i: CAST(concat('0x', substr(hex(encode({x})), 2 * i + 1, 2)) AS BIGINT))"
    return f"xor(list_reduce({codes}, lambda c, b: xor(c >> 8, {table}[1 + (xor(c, b) & 255)]), 4294967295), 4294967295)"


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op2_warc_writer": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body)) AS n, sha256(body) AS digest FROM p),
f AS (SELECT digest, min(page_id) AS first_page FROM d WHERE n >= 100 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id > first_page THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first_page THEN first_page END AS refers_to
FROM d LEFT JOIN f USING (digest)""",
    "op3_quality_cascade": rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT doc_id, x, regexp_extract_all(x, '{_WORDS}') AS ws,
             list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '{_WORDS}')) AS ls FROM t),
tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
c AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(x, '{_WS}', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(x) - length(translate(x, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
             len(ls) AS n_lines, len(list_filter(ws, lambda a: regexp_matches(a, '\p{{L}}'))) AS with_letter,
             length(regexp_replace(x, '[^\p{{Lu}}]+', '', 'g')) AS capitals
      FROM w LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 3 * n_words OR word_chars > 10 * n_words
            OR 10 * n_dup_lines > 3 * n_lines OR 10 * with_letter < 8 * n_words OR 2 * capitals > word_chars) AS kept
FROM b""",
    "op6_suffix_array_dedup": """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM t WHERE length(h) >= 100)),
m AS (SELECT g, min(doc_id) AS least FROM s GROUP BY g),
hit AS (SELECT doc_id, i FROM s JOIN m USING (g) WHERE least < doc_id),
isl AS (SELECT doc_id, i, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS island
        FROM (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 50, true) AS gap FROM hit)),
span AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM isl GROUP BY doc_id, island),
kept AS (SELECT doc_id, b AS a, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY a), 1000000000) AS b FROM span
         UNION ALL SELECT doc_id, 0, min(a) FROM span GROUP BY doc_id),
txt AS (SELECT kept.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS k FROM kept JOIN t USING (doc_id) GROUP BY kept.doc_id),
agg AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM span GROUP BY doc_id)
SELECT t.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM t LEFT JOIN agg ON agg.doc_id = t.doc_id LEFT JOIN txt ON txt.doc_id = t.doc_id""",
    "op9_license_digests": _license_sql(),
    "op10_circulant_minhash": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) = 1 THEN ws[1] ELSE ws[i] || ' ' || ws[i + 1] END AS s
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws), 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
i AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 80 * (x.n + y.n - m)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node WHERE r.root < e.b),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id""",
    "op11_periodic_runs": rf"""
WITH t AS MATERIALIZED (SELECT {_CRC_TABLE} AS tab),
o AS MATERIALIZED (SELECT doc_id, ws, len(ws) AS n, {_crc32('CAST(doc_id AS VARCHAR)', 'tab')} AS h
      FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS ws FROM documents), t),
p AS (SELECT doc_id, ws, n, h, a, 1 + (n - a) // (3 + (h // 10) % 8) AS p
      FROM (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM o)),
w AS MATERIALIZED (SELECT doc_id, n, CASE WHEN a IS NULL THEN ws
             ELSE list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS ws FROM p),
s AS MATERIALIZED (SELECT doc_id, i, array_to_string(ws[i + 1:i + 6], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(n - 5)) AS i FROM w)),
pairs AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.g = b.g AND a.i < b.i),
isl AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs),
st AS (SELECT doc_id, q, min(i) AS start, count(*) + 5 + q AS length FROM isl GROUP BY doc_id, q, island),
runs AS MATERIALIZED (SELECT doc_id, start, length, min(q) AS period FROM st WHERE length >= 12 AND length >= 2 * q GROUP BY doc_id, start, length),
agg AS (SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines,
               min((-length, start, period)) AS top FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT x.doc_id, string_agg(x.w, ' ' ORDER BY x.i) AS c
         FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(n)) AS i FROM w) x ANTI JOIN gone USING (doc_id, i) GROUP BY x.doc_id),
best AS (SELECT doc_id, n_runs, lines, -struct_extract_at(top, 1) AS length, struct_extract_at(top, 2) AS start, struct_extract_at(top, 3) AS period FROM agg)
SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length,
       CAST(period AS BIGINT) AS period, CAST(1000 * length // period AS BIGINT) AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(c, '')) AS collapsed_sha256
FROM documents d LEFT JOIN best ON best.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id""",
    "op13_spelling_variants": rf"""
WITH RECURSIVE t AS MATERIALIZED (SELECT {_CRC_TABLE} AS tab),
r AS (SELECT doc_id, r, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[a-zÀ-ÿ]+')) AS r FROM documents)
      WHERE length(r) >= 7 GROUP BY doc_id, r),
h AS (SELECT r, c, {_crc32("concat(doc_id, ':', r)", 'tab')} AS h FROM r, t),
v AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n
      FROM (SELECT CASE WHEN h % 31 = 0 THEN concat(substr(r, 1, h % length(r)), substr(r, h % length(r) + 2)) ELSE r END AS word, c FROM h)
      WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
d AS MATERIALIZED (SELECT DISTINCT word, concat(substr(word, 1, i), substr(word, i + 2)) AS x FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
e AS (SELECT v.word AS a, d.word AS b FROM v JOIN d ON d.x = v.word
      UNION SELECT d.word, v.word FROM v JOIN d ON d.x = v.word
      UNION SELECT a.word, b.word FROM d a JOIN d b ON a.x = b.x AND a.word <> b.word
            WHERE len(list_filter(range(1, length(a.word) + 1), lambda i: substr(a.word, i, 1) <> substr(b.word, i, 1))) = 1),
near AS (SELECT a AS word, count(*) AS n_near, min((-v.n, b)) AS top FROM e JOIN v ON v.word = b GROUP BY a),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near,
             CASE WHEN -struct_extract_at(top, 1) >= 10 * v.n THEN struct_extract_at(top, 2) END AS form,
             CASE WHEN -struct_extract_at(top, 1) >= 10 * v.n THEN -struct_extract_at(top, 1) END AS form_n FROM v LEFT JOIN near USING (word)),
way AS (SELECT word, word AS last FROM f UNION ALL SELECT way.word, f.form FROM way JOIN f ON f.word = way.last WHERE f.form IS NOT NULL),
root AS (SELECT way.word, last AS root FROM way JOIN f ON f.word = way.last WHERE f.form IS NULL)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM f JOIN root USING (word)""",
}
