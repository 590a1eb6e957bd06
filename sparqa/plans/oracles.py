"""DuckDB SQL oracles, one per registered query key (same column names).

The SQL is written against the driver's pre-registered views. Helper builders
below produce the DuckDB spelling of the shared stand-ins (strip, tokens, hash
vectors, the recursive chunker).
"""

from __future__ import annotations

# The characters Python's str.strip() removes (Unicode White_Space
# plus U+001C..U+001F), as an RE2 character class.
_WS = r"[\t\n\x0b\x0c\r \x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

SQL: dict[str, str] = {}


def lit(text: str) -> str:
    """A DuckDB string literal (newlines kept, quotes doubled)."""
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def tokens(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


def statements(x: str) -> str:
    return f"list_filter(list_transform(string_split(coalesce({x}, ''), '.'), lambda s: {strip('s')}), lambda s: s <> '')"


def dims(tok: str, prefix: str = "d") -> str:
    return ", ".join(f"('0x' || substr(md5({tok}), {2 * i + 1}, 2))::INT - 127.5 AS {prefix}{i}"
                     for i in range(16))


def sums(prefix: str = "d") -> str:
    return ", ".join(f"sum({prefix}{i}) AS {prefix}{i}" for i in range(16))


def dot(a: str, b: str, prefix: str = "d") -> str:
    return " + ".join(f"{a}.{prefix}{i} * {b}.{prefix}{i}" for i in range(16))


def cosine(a: str, b: str) -> str:
    den = f"(sqrt({dot(a, a)}) * sqrt({dot(b, b)}))"
    return f"CASE WHEN {den} = 0 THEN 0.0 ELSE ({dot(a, b)}) / {den} END"


def zero_fill(alias: str, prefix: str = "d") -> str:
    return ", ".join(f"coalesce({alias}.{prefix}{i}, 0.0) AS {prefix}{i}" for i in range(16))


_SEPS = ["chr(10) || chr(10)", "chr(10)", "'.'", "' '"]


def _split_level(x: str, level: int, n: int, depth: int = 0) -> str:
    v = f"p{depth}"
    parts = f"string_split({x}, {_SEPS[level]})"
    if level == len(_SEPS) - 1:
        return f"list_transform({parts}, lambda {v}: {strip(v)})"
    inner = _split_level(v, level + 1, n, depth + 1)
    return (f"flatten(list_transform({parts}, lambda {v}: CASE WHEN length({v}) > {n} "
            f"THEN {inner} ELSE [{strip(v)}] END))")


def split_pieces(x: str, n: int) -> str:
    return _split_level(f"coalesce({x}, '')", 0, n)


def chunk_list(x: str, n: int) -> str:
    """DuckDB expression for the whole chunker, as a list; blank chunks dropped."""
    pieces = split_pieces(x, n)
    step = (f"lambda acc, p: CASE WHEN length(acc.buf) + length(p) + 1 <= {n} "
            f"THEN {{'chunks': acc.chunks, 'buf': acc.buf || p || ' '}} "
            f"ELSE {{'chunks': list_append(acc.chunks, {strip('acc.buf')}), 'buf': p}} END")
    red = f"list_reduce({pieces}, {step}, {{'chunks': []::VARCHAR[], 'buf': ''}})"
    return red


def chunks_cte(n: int = 500, src: str = "documents") -> str:
    """CTEs ``red``, ``chunks(doc_id, pos, chunk)`` over a (doc_id, text) source."""
    return f"""
red AS (SELECT doc_id, {chunk_list('text', n)} AS r FROM {src}),
packed AS (SELECT doc_id, list_filter(CASE WHEN r.buf <> '' THEN list_append(r.chunks, {strip('r.buf')})
                                     ELSE r.chunks END, lambda c: c <> '') AS cs FROM red),
chunks AS MATERIALIZED (SELECT doc_id, unnest(range(len(cs)))::INT AS pos, unnest(cs) AS chunk FROM packed)"""


def text_vectors_cte(name: str, src: str, keys: str, text: str) -> str:
    """CTE ``name(keys, d0..d15)``: hash vectors; rows without tokens get zeros."""
    return f"""
{name}_tok AS (SELECT {keys}, unnest({tokens(text)}) AS tok FROM {src}),
{name}_sum AS (SELECT {keys}, {sums()} FROM (SELECT {keys}, {dims('tok')} FROM {name}_tok) GROUP BY ALL),
{name} AS (SELECT {', '.join('s.' + k.strip() for k in keys.split(','))}, {zero_fill('v')}
           FROM {src} s LEFT JOIN {name}_sum v USING ({keys}))"""


def topk_cte(k: int = 3) -> str:
    """CTE ``hits(qid, rank, doc_id, pos, chunk, score)`` from ``qv`` x ``cv`` + chunks."""
    return f"""
scored AS (SELECT q.qid, c.doc_id, c.pos, {cosine('q', 'c')} AS score FROM qv q, cv c),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id, pos) AS rank FROM scored),
hits AS MATERIALIZED (SELECT r.qid, r.rank::INT AS rank, r.doc_id, r.pos, ch.chunk, r.score
         FROM ranked r JOIN chunks ch USING (doc_id, pos) WHERE r.rank <= {k})"""


def _retrieval_prefix(k: int = 3, questions: str = "SELECT item_id AS qid, text AS question FROM benchmark") -> str:
    return f"""WITH {chunks_cte(500)},
{text_vectors_cte('cv', 'chunks', 'doc_id, pos', 'chunk')},
qs AS ({questions}),
{text_vectors_cte('qv', 'qs', 'qid', 'question')},
{topk_cte(k)}"""


_CTX = "string_agg(substr(chunk, 1, 800), ' ' ORDER BY rank)"


SQL["ask"] = _retrieval_prefix(3) + f""",
ctx AS (SELECT qid, count(*)::INT AS n_contexts,
               string_agg(substr(chunk, 1, 800), ' ' ORDER BY rank) AS context,
               {strip(_CTX)} AS generated_answer
        FROM hits GROUP BY qid)
SELECT qs.qid, qs.question, coalesce(ctx.n_contexts, 0) AS n_contexts,
       coalesce(ctx.context, '') AS context, coalesce(ctx.generated_answer, '') AS generated_answer
FROM qs LEFT JOIN ctx USING (qid)
"""


def render_template(template: str, **values: str) -> str:
    """DuckDB concat of a template with one-pass placeholder substitution."""
    pieces, rest = [], template
    while rest:
        hits = [(rest.find("{" + k + "}"), k) for k in values if ("{" + k + "}") in rest]
        if not hits:
            pieces.append("'" + rest.replace("'", "''") + "'")
            break
        at, name = min(hits)
        if at:
            pieces.append("'" + rest[:at].replace("'", "''") + "'")
        pieces.append(f"coalesce({values[name]}, '')")
        rest = rest[at + len(name) + 2:]
    return " || ".join(pieces) if pieces else "''"


# ------------------------------------------------------------------ chunking
SQL["split_pieces"] = f"""
WITH s AS (SELECT doc_id, {split_pieces('text', 120)} AS ps FROM documents)
SELECT doc_id, unnest(range(len(ps)))::INT AS pos, unnest(ps) AS piece FROM s"""

SQL["chunk_documents"] = f"WITH {chunks_cte(500)} SELECT doc_id, pos, chunk FROM chunks"
SQL["chunk_documents_120"] = f"WITH {chunks_cte(120)} SELECT doc_id, pos, chunk FROM chunks"
SQL["chunk_stats"] = (f"WITH {chunks_cte(500)} SELECT count(*) AS n_chunks, "
                      f"count(DISTINCT doc_id) AS n_docs FROM chunks")
SQL["enrich_entities"] = rf"""WITH {chunks_cte(500)},
m AS (SELECT doc_id, pos, chunk, regexp_extract_all(chunk, '\p{{Lu}}\p{{Ll}}+') AS f FROM chunks)
SELECT doc_id, pos, CASE WHEN len(f) > 0 THEN chunk || chr(10) || chr(10) || '[Entities: '
       || array_to_string(list_transform(f, lambda x: x || '(TERM)'), ', ') || ']' ELSE chunk END AS chunk
FROM m"""

ENTITY_SQL = r"""(SELECT surface, min(label) AS label FROM (
  SELECT surface, CASE WHEN length(surface) < 4 THEN 'SHORT' ELSE 'NAME' END AS label
  FROM (SELECT unnest(regexp_extract_all(text, '\p{Lu}\p{L}+')) AS surface FROM benchmark)
  UNION ALL SELECT unnest(regexp_extract_all(text, '\p{Lu}\p{L}+ \p{L}+')) AS surface, 'PHRASE' AS label FROM benchmark) GROUP BY surface)"""
SQL["enrich_gazetteer"] = rf"""WITH {chunks_cte(500)},
e AS MATERIALIZED {ENTITY_SQL},
n AS (SELECT DISTINCT length(surface) AS n FROM e),
p AS (SELECT doc_id, pos, chunk, unnest(range(1, length(chunk) + 1)) AS i FROM chunks),
s AS MATERIALIZED (SELECT * FROM p WHERE regexp_matches(substr(chunk, i, 1), '\p{{Lu}}')
       AND (i = 1 OR NOT regexp_matches(substr(chunk, i - 1, 1), '[\p{{L}}\p{{N}}]'))),
c AS (SELECT s.doc_id, s.pos, s.i, e.surface, e.label FROM s, n JOIN e ON e.surface = substr(s.chunk, s.i, n.n)
      WHERE s.i + n.n > length(s.chunk) OR NOT regexp_matches(substr(s.chunk, s.i + n.n, 1), '[\p{{L}}\p{{N}}]')),
b AS (SELECT doc_id, pos, i, arg_max({{'i': i, 'n': length(surface), 't': concat(surface, '(', label, ')')}}, length(surface)) AS m FROM c GROUP BY ALL),
g AS (SELECT doc_id, pos, list(m ORDER BY i) AS ms FROM b GROUP BY doc_id, pos),
l AS (SELECT doc_id, pos, list_reduce(ms, lambda acc, x: CASE WHEN x.i >= acc.free
        THEN {{'free': x.i + x.n, 'out': list_append(acc.out, x.t)}} ELSE acc END, {{'free': 0::BIGINT, 'out': []::VARCHAR[]}}).out AS found FROM g)
SELECT ch.doc_id, ch.pos, CASE WHEN found IS NOT NULL THEN chunk || chr(10) || chr(10) || '[Entities: ' || array_to_string(found, ', ') || ']' ELSE chunk END AS chunk
FROM chunks ch LEFT JOIN l ON l.doc_id = ch.doc_id AND l.pos = ch.pos"""

# ------------------------------------------------------------------ embedding
SQL["embed_chunks"] = f"""WITH {chunks_cte(500)},
{text_vectors_cte('cv', 'chunks', 'doc_id, pos', 'chunk')}
SELECT doc_id, pos, {', '.join(f'd{i}::FLOAT AS e{i}' for i in range(16))} FROM cv"""

SQL["embed_records"] = f"""WITH qs AS (SELECT item_id AS qid, text AS question FROM benchmark),
{text_vectors_cte('qv', 'qs', 'qid', 'question')}
SELECT qs.qid, qs.question AS text, 16 AS dim, ({dot('qv', 'qv')})::DOUBLE AS norm2
FROM qs JOIN qv USING (qid)"""

SQL["embedding_dim"] = """SELECT min(len(embedding))::INT AS min_dim, max(len(embedding))::INT AS max_dim,
count(*) AS n_vectors FROM embeddings"""

# ------------------------------------------------------------------ collection
SQL["collection_create"] = """SELECT 'vectors' AS name, 64 AS dim, 'cosine' AS distance,
count(*) AS n_points, 'created' AS first_action, 'reused' AS second_action FROM embeddings"""
SQL["collection_dim_check"] = """WITH d AS (SELECT max(len(embedding))::INT AS dim, count(*) AS n FROM embeddings)
SELECT dim, n AS n_vectors, 'reused' AS right_length,
  'collection ''vectors'' holds vectors of length ' || dim || ', those given have ' || dim // 2
    || '; index into another one or pass recreate_on_dimension_mismatch=True' AS wrong_length,
  n AS n_after_error, 'recreated' AS when_asked, dim // 2 AS new_dim, 0::BIGINT AS n_after_recreate FROM d"""
SQL["collection_append"] = """SELECT label::VARCHAR AS label, 2 * count(*) AS n_points,
count(DISTINCT vec_id) AS n_ids FROM embeddings GROUP BY 1"""
SQL["collection_count"] = (f"WITH {chunks_cte(500)} SELECT count(*) AS n_points, "
                           f"count(DISTINCT doc_id) AS n_docs FROM chunks")
SQL["index_corpus"] = f"WITH {chunks_cte(500)} SELECT doc_id, pos, chunk AS text, 16 AS dim FROM chunks"
SQL["index_stream"] = SQL["index_corpus"]

SQL["index_changes"] = f"""WITH {chunks_cte(500)},
k AS (SELECT count_if(doc_id % 10 = 3)::BIGINT AS n_new, count_if(doc_id % 7 = 0 AND doc_id % 10 <> 3)::BIGINT AS n_changed,
             count_if(doc_id % 11 = 0)::BIGINT AS n_gone FROM documents)
SELECT doc_id, pos, chunk AS text, n_new, n_changed, n_gone FROM chunks, k"""
SQL["stream_replace"] = f"""WITH src AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Draft. ' || text ELSE text END AS text
  FROM documents WHERE doc_id % 3 = 0 OR doc_id % 13 <> 0), {chunks_cte(500, 'src')}
SELECT doc_id, pos, chunk AS text FROM chunks"""

_COS_F = ("CASE WHEN sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)) = 0 THEN 0.0 "
          "ELSE list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))) END")
SQL["knn_cosine"] = f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS qid, p.vec_id, (SELECT {_COS_F} FROM (SELECT q.e AS a, p.e AS b)) AS score
      FROM v q, v p),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT qid, rank::INT AS rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 3"""

SQL["knn_pruned"] = SQL["knn_cosine"]

SQL["knn_single"] = f"""
WITH x AS (SELECT i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) t(i) GROUP BY i),
q AS (SELECT list(m ORDER BY i) AS a FROM x),
s AS (SELECT vec_id, (SELECT {_COS_F} FROM (SELECT q.a AS a, embedding::DOUBLE[] AS b)) AS score
      FROM embeddings, q)
SELECT vec_id, round(score, 6) AS score FROM s ORDER BY score DESC, vec_id LIMIT 3"""

# ------------------------------------------------------------------ answering
SQL["retrieve_topk"] = _retrieval_prefix(3) + """
SELECT qid, rank, doc_id, pos, chunk AS text, score FROM hits"""

SQL["retrieved_contexts"] = _retrieval_prefix(3) + """
SELECT qid, (rank - 1)::INT AS pos, chunk AS context FROM hits"""

SQL["build_context"] = _retrieval_prefix(3) + f"""
SELECT qid, {_CTX} AS context FROM hits GROUP BY qid"""


def _prompts_sql() -> str:
    from sparqa.operators.answer import PLAIN_TEMPLATE, RAG_TEMPLATE
    rag = render_template(RAG_TEMPLATE, context="coalesce(c.context, '')", question="qs.question")
    plain = render_template(PLAIN_TEMPLATE, question="qs.question")
    return _retrieval_prefix(3) + f""",
c AS (SELECT qid, {_CTX} AS context FROM hits GROUP BY qid)
SELECT qs.qid, u.use_rag, CASE WHEN u.use_rag THEN {rag} ELSE {plain} END AS prompt
FROM qs LEFT JOIN c USING (qid), (VALUES (true), (false)) u(use_rag)"""


SQL["build_prompts"] = _prompts_sql()
SQL["generate_answers"] = _retrieval_prefix(3) + f"""
SELECT qs.qid, coalesce({strip(_CTX)}, '') AS generated_answer
FROM qs LEFT JOIN hits USING (qid) GROUP BY qs.qid"""

QA_SQL = """(SELECT u.conv_id * 4294967296 + u.turn AS row_id, u.text AS question, a.text AS answer
  FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user')"""

SQL["run_generation"] = _retrieval_prefix(3, f"SELECT row_id AS qid, question FROM {QA_SQL}") + f""",
r AS (SELECT qs.qid AS row_id, true AS use_rag,
             coalesce({strip(_CTX)}, '') AS generated_answer,
             count(hits.qid)::INT AS n_contexts
      FROM qs LEFT JOIN hits USING (qid) GROUP BY qs.qid)
SELECT * FROM r
UNION ALL SELECT qid AS row_id, false AS use_rag, '' AS generated_answer, 0 AS n_contexts FROM qs"""


# ================================================================== shared relations

SCORED_SQL = """(SELECT d.doc_id AS row_id, d.text AS question, d.source AS answer, d.lang AS experiment,
  CASE WHEN d.doc_id % 3 = 0 THEN '' ELSE d.source || ': ' || d.text END AS generated_answer,
  CASE WHEN d.doc_id % 5 = 0 THEN '[]' ELSE '[''' || d.source || ''', ''' || d.lang || ''']' END AS retrieved_contexts,
  l.quality::DOUBLE AS context_precision,
  CASE WHEN d.doc_id % 7 = 0 THEN NULL ELSE (d.n_chars % 100)::DOUBLE / 100 END AS context_recall,
  l.toxic::DOUBLE AS faithfulness,
  CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE (d.n_chars % 10)::DOUBLE / 10 END AS answer_relevancy
 FROM documents d LEFT JOIN labels l USING (doc_id))"""

SECOND_SQL = """(SELECT doc_id AS row_id, text AS question, source AS answer, lang AS experiment,
  (doc_id % 4)::DOUBLE / 4 AS context_precision,
  CASE WHEN doc_id % 13 = 0 THEN NULL ELSE (doc_id % 9)::DOUBLE / 9 END AS context_recall,
  (doc_id % 2)::DOUBLE AS faithfulness,
  CASE WHEN doc_id % 17 = 0 THEN NULL ELSE (doc_id % 5)::DOUBLE / 5 END AS answer_relevancy
 FROM documents)"""

def _cfg_sql() -> str:
    from sparqa.plans.fixtures import EXPERIMENTS
    rows = ",\n  ".join(f"({i}, '{n}', '{m}', {str(r).lower()}, '{x}')" for i, (n, m, r, x) in enumerate(EXPERIMENTS))
    return f"(SELECT * FROM (VALUES {rows})\n  t(ord, experiment, generator_model, use_rag, output_suffix))"


CFG_SQL = _cfg_sql()

DOCS_GAPS_SQL = """(SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN '  ' || chr(10) ELSE text END AS text,
  CASE WHEN doc_id % 97 = 0 THEN 'ExtractionError: unreadable' END AS error FROM documents)"""

def _types():
    from sparqa.operators.insight import QUESTION_TYPES, TEMPLATE_PATTERN, UNKNOWN_TYPE
    return [n for n, _ in QUESTION_TYPES], [k for _, k in QUESTION_TYPES], UNKNOWN_TYPE, TEMPLATE_PATTERN


TYPE_NAMES, TYPE_KEYWORDS, UNKNOWN_TYPE, TEMPLATE_PATTERN = _types()

TEMPLATE_SQL = f"""(SELECT doc_id AS row_id,
  'Pasien dengan ' || source || ' dan diagnosis medis: ' || lang || '. Jelaskan '
    || [{', '.join("'" + n + "'" for n in TYPE_NAMES)}][doc_id % 8 + 1] || '?' AS question,
  coalesce({strip('text')}, '') AS answer FROM documents)"""


def qtype(x: str) -> str:
    whens = " ".join(f"WHEN contains(lower({x}), '{k}') THEN '{n}'" for n, k in zip(TYPE_NAMES, TYPE_KEYWORDS))
    return f"CASE {whens} ELSE {lit(UNKNOWN_TYPE)} END"


def vec16(x: str) -> str:
    """In-row hash vector of a text as a DOUBLE list."""
    return (f"list_transform(range(16), lambda i: coalesce(list_sum(list_transform({tokens(x)}, "
            f"lambda t: ('0x' || substr(md5(t), 2 * i + 1, 2))::INT - 127.5)), 0.0))")


def lcos(a: str, b: str) -> str:
    den = f"(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"
    return f"CASE WHEN {den} = 0 THEN 0.0 ELSE list_dot_product({a}, {b}) / {den} END"


def generated_ctes(qa: str = QA_SQL) -> str:
    """CTEs up to ``gen``: the QA rows under the four configs, retrieval shared by RAG rows."""
    return _retrieval_prefix(3, f"SELECT row_id AS qid, coalesce(question, 'nan') AS question FROM {qa}") + f""",
ctxl AS (SELECT qid AS row_id, list(chunk ORDER BY rank) AS ctx,
                {strip(_CTX)} AS ans
         FROM hits GROUP BY qid),
qa AS (SELECT row_id, coalesce(question, 'nan') AS question, coalesce(answer, 'nan') AS answer FROM {qa}),
gen AS MATERIALIZED (SELECT qa.row_id, qa.question, qa.answer, cfg.experiment, cfg.generator_model, cfg.use_rag,
               CASE WHEN cfg.use_rag THEN coalesce(ctxl.ans, '') ELSE '' END AS generated_answer,
               CASE WHEN cfg.use_rag THEN coalesce(ctxl.ctx, []::VARCHAR[]) ELSE []::VARCHAR[] END
                 AS retrieved_contexts
        FROM qa LEFT JOIN ctxl USING (row_id), {CFG_SQL} cfg)"""


def _sup(s: str, t: str) -> str:
    return f"2 * len(list_intersect({s}, {t})) >= len({s})"


def judge_ctes(src: str = "gen") -> str:
    """CTEs ``j2`` (verdict lists) and ``judged`` (four metrics) over ``src``."""
    return f""",
j0 AS (SELECT *, list_transform(retrieved_contexts, lambda c: list_distinct({tokens('c')})) AS ctx_t,
              list_transform({statements('answer')}, lambda s: list_distinct({tokens('s')})) AS ref_st,
              list_transform({statements('generated_answer')}, lambda s: list_distinct({tokens('s')})) AS ans_st
       FROM {src}),
j1 AS (SELECT *, list_distinct(flatten(ctx_t)) AS all_t,
              list_transform(ctx_t, lambda ct: CASE WHEN list_bool_or(list_transform(ref_st,
                  lambda s: {_sup('s', 'ct')})) THEN 1 ELSE 0 END) AS v_cp
       FROM j0),
j2 AS MATERIALIZED (SELECT *, list_transform(ref_st, lambda s: CASE WHEN {_sup('s', 'all_t')} THEN 1 ELSE 0 END) AS v_cr,
              list_transform(ans_st, lambda s: CASE WHEN {_sup('s', 'all_t')} THEN 1 ELSE 0 END) AS v_f,
              list_transform({statements('generated_answer')}, lambda g: {lcos(vec16('question'), vec16('g'))}) AS sims
       FROM j1),
judged AS (SELECT *,
   CASE WHEN use_rag THEN (CASE WHEN coalesce(list_sum(v_cp), 0) > 0
        THEN list_sum(list_transform(v_cp, lambda x, i: x * list_sum(v_cp[1:i]) / i)) / list_sum(v_cp)
        ELSE 0.0 END) END AS context_precision,
   CASE WHEN use_rag AND len(v_cr) > 0 THEN list_sum(v_cr) / len(v_cr) END AS context_recall,
   CASE WHEN use_rag AND len(v_f) > 0 THEN list_sum(v_f) / len(v_f) END AS faithfulness,
   CASE WHEN generated_answer IS NULL OR {strip('generated_answer')} = '' THEN 0.0
        WHEN len(sims) > 0 THEN list_sum(sims) / len(sims) END AS answer_relevancy
   FROM j2)"""


def bertscore_ctes(src: str, keys: list[str], cand: str, ref: str, name: str = "bs") -> str:
    """CTE ``name(keys, p, r, f)``: greedy max-cosine token matching per row."""
    k = ", ".join(keys)
    on = " AND ".join(f"x.{c} = y.{c}" for c in keys)
    return f""",
{name}_c AS MATERIALIZED (SELECT {k}, t, count(*) AS n FROM (SELECT {k}, unnest({tokens(cand)}) AS t FROM {src}) GROUP BY ALL),
{name}_r AS MATERIALIZED (SELECT {k}, t, count(*) AS n FROM (SELECT {k}, unnest({tokens(ref)}) AS t FROM {src}) GROUP BY ALL),
{name}_tv AS MATERIALIZED (SELECT t, {dims('t')} FROM (SELECT t FROM {name}_c UNION SELECT t FROM {name}_r)),
{name}_p AS (SELECT {', '.join('x.' + c for c in keys)}, x.t AS ct, y.t AS rt, {cosine('a', 'b')} AS s
             FROM {name}_c x JOIN {name}_r y ON {on} JOIN {name}_tv a ON a.t = x.t JOIN {name}_tv b ON b.t = y.t),
{name}_bc AS (SELECT {k}, ct, max(s) AS m FROM {name}_p GROUP BY ALL),
{name}_br AS (SELECT {k}, rt, max(s) AS m FROM {name}_p GROUP BY ALL),
{name}_pp AS (SELECT {', '.join('x.' + c for c in keys)}, sum(y.m * x.n) / sum(x.n) AS p
              FROM {name}_c x JOIN {name}_bc y ON {on} AND y.ct = x.t GROUP BY ALL),
{name}_rr AS (SELECT {', '.join('x.' + c for c in keys)}, sum(y.m * x.n) / sum(x.n) AS r
              FROM {name}_r x JOIN {name}_br y ON {on} AND y.rt = x.t GROUP BY ALL),
{name} AS (SELECT {', '.join('s.' + c for c in keys)}, coalesce(pp.p, 0.0) AS p, coalesce(rr.r, 0.0) AS r,
                  CASE WHEN coalesce(pp.p, 0.0) + coalesce(rr.r, 0.0) = 0 THEN 0.0
                       ELSE 2 * coalesce(pp.p, 0.0) * coalesce(rr.r, 0.0) / (coalesce(pp.p, 0.0) + coalesce(rr.r, 0.0))
                  END AS f
           FROM {src} s LEFT JOIN {name}_pp pp USING ({k}) LEFT JOIN {name}_rr rr USING ({k}))"""


def r6(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


# ================================================================== S1-S12, F1
SQL["corpus_scan"] = "SELECT doc_id, length(text)::INT AS n_chars, lang FROM documents"
SQL["assemble_pages"] = """SELECT conv_id AS doc_id, string_agg(coalesce(text, ''), '' ORDER BY turn) AS text
FROM conversations GROUP BY conv_id"""
SQL["drop_empty_docs"] = f"SELECT doc_id FROM {DOCS_GAPS_SQL} WHERE text IS NOT NULL AND {strip('text')} <> ''"
SQL["skip_failed_docs"] = f"""WITH g AS (SELECT doc_id, text FROM {DOCS_GAPS_SQL}
  WHERE text IS NOT NULL AND {strip('text')} <> '' AND error IS NULL), {chunks_cte(500, 'g')}
SELECT doc_id, count(*) AS n_chunks FROM chunks GROUP BY doc_id"""
SQL["failed_docs"] = f"SELECT doc_id, error FROM {DOCS_GAPS_SQL} WHERE error IS NOT NULL"
SQL["load_qa"] = f"SELECT row_id, question, answer FROM {QA_SQL}"

_PARSED = f"""(SELECT *, CASE WHEN retrieved_contexts = '[]' THEN []::VARCHAR[]
  ELSE regexp_extract_all(retrieved_contexts, '''([^'']*)''', 1) END AS ctx FROM {SCORED_SQL})"""
SQL["load_generated"] = f"""SELECT s.row_id, s.question, s.answer, s.generated_answer, u.pos, u.context
FROM {_PARSED} s LEFT JOIN (SELECT row_id, unnest(range(len(ctx)))::INT AS pos, unnest(ctx) AS context
  FROM {_PARSED}) u USING (row_id)"""
SQL["parse_contexts"] = f"""SELECT s.row_id, u.pos, u.context
FROM {_PARSED} s LEFT JOIN (SELECT row_id, unnest(range(len(ctx)))::INT AS pos, unnest(ctx) AS context
  FROM {_PARSED}) u USING (row_id)"""
SQL["save_results_roundtrip"] = f"""SELECT row_id, experiment, sha256(question) AS question_sha, sha256(answer) AS answer_sha,
  sha256(generated_answer) AS generated_answer_sha, array_to_string(ctx, '|') AS contexts,
  {r6('context_precision', 'context_recall', 'faithfulness', 'answer_relevancy')}, true AS csv_equal FROM {_PARSED}"""

SQL["output_paths"] = f"""WITH b AS (SELECT doc_id, 'results/' || lang || '/' || source AS stem, doc_id % 4 AS e,
  CASE WHEN doc_id % 5 = 0 THEN 'given/' || source || '.csv' END AS given FROM documents),
o AS (SELECT doc_id, cfg.experiment, cfg.output_suffix AS suf, given, CASE e
    WHEN 0 THEN stem || '_' || cfg.output_suffix || '.csv'
    WHEN 1 THEN stem || '_' || cfg.output_suffix || '.csv'
    WHEN 2 THEN stem || '.tar_' || cfg.output_suffix || '.gz'
    ELSE stem || '.csv_' || cfg.output_suffix || '.bak' END AS output_path FROM b, {CFG_SQL} cfg)
SELECT doc_id, experiment, output_path, replace(output_path, '.csv', '_nan_fixed.csv') AS repaired_path,
  coalesce(given, output_path) AS input_path FROM o"""

# ================================================================== X1-X7
SQL["experiment_grid"] = f"""SELECT qa.row_id, cfg.ord, cfg.experiment, cfg.generator_model, cfg.use_rag,
  cfg.output_suffix FROM {QA_SQL} qa, {CFG_SQL} cfg"""
SQL["experiment_select"] = f"""SELECT row_id, 'gpt_oss_without_rag' AS experiment, false AS use_rag FROM {QA_SQL}"""
SQL["tag_results"] = f"SELECT row_id, experiment, 'llama_with_rag' AS tagged FROM {SCORED_SQL}"
SQL["limit_rows"] = f"""WITH q AS (SELECT row_id, row_number() OVER (ORDER BY row_id) AS rn, count(*) OVER () AS n
  FROM {QA_SQL})
SELECT row_id, 5 AS "limit" FROM q WHERE rn <= 5
UNION ALL SELECT row_id, -100 AS "limit" FROM q WHERE rn <= n - 100"""

_GEN = generated_ctes()
SQL["run_summary"] = _GEN + """
SELECT experiment, 'results/rag_combined_results_' || experiment || '.csv' AS output_path, 'all' AS action,
  count(*) AS n_rows FROM gen GROUP BY experiment"""

# ================================================================== T1-T12
SQL["bertscore"] = f"WITH qa AS (SELECT * FROM {QA_SQL})" + bertscore_ctes(
    "qa", ["row_id"], "question", "answer") + """
SELECT row_id, round(p, 6) AS bertscore_precision, round(r, 6) AS bertscore_recall, round(f, 6) AS bertscore_f1
FROM bs"""
SQL["bertscore_means"] = _GEN + bertscore_ctes("gen", ["row_id", "experiment"], "generated_answer", "answer") + """
SELECT experiment, round(avg(p), 6) AS bertscore_precision_mean, round(avg(r), 6) AS bertscore_recall_mean,
  round(avg(f), 6) AS bertscore_f1_mean FROM bs GROUP BY experiment"""
SQL["judge_input"] = _GEN + """
SELECT row_id, experiment, question AS user_input, generated_answer AS response, answer AS reference,
  len(retrieved_contexts)::INT AS n_contexts FROM gen"""
SQL["judge_metrics"] = _GEN + """
SELECT row_id, experiment, unnest(range(len(m)))::INT AS pos, unnest(m) AS metric
FROM (SELECT row_id, experiment, CASE WHEN use_rag
  THEN ['context_precision', 'context_recall', 'faithfulness', 'answer_relevancy'] ELSE ['answer_relevancy'] END AS m
  FROM gen)"""
_JUDGED = _GEN + judge_ctes("gen")
for _m in ("context_precision", "context_recall", "faithfulness", "answer_relevancy"):
    SQL[_m] = _JUDGED + f"\nSELECT row_id, experiment, round({_m}, 6) AS {_m} FROM judged"
SQL["judge_verdicts"] = _JUDGED + """,
rag AS (SELECT * FROM j2 WHERE use_rag)
SELECT row_id, experiment, 'context_precision' AS metric, unnest(range(len(v_cp)))::INT AS idx,
  unnest(v_cp)::INT AS verdict FROM rag
UNION ALL SELECT row_id, experiment, 'context_recall', unnest(range(len(v_cr)))::INT, unnest(v_cr)::INT FROM rag
UNION ALL SELECT row_id, experiment, 'faithfulness', unnest(range(len(v_f)))::INT, unnest(v_f)::INT FROM rag"""
SQL["attach_metrics"] = _JUDGED + """
SELECT row_id, experiment, round(CASE WHEN use_rag THEN context_precision END, 6) AS context_precision,
  round(CASE WHEN use_rag THEN faithfulness END, 6) AS faithfulness FROM judged"""
SQL["judge_means"] = _JUDGED + """
SELECT experiment, round(avg(coalesce(context_precision, 0)), 6) AS context_precision_mean,
  round(avg(coalesce(context_recall, 0)), 6) AS context_recall_mean,
  round(avg(coalesce(faithfulness, 0)), 6) AS faithfulness_mean,
  round(avg(coalesce(answer_relevancy, 0)), 6) AS answer_relevancy_mean FROM judged GROUP BY experiment"""
_FULL = _JUDGED + bertscore_ctes("gen", ["row_id", "experiment"], "generated_answer", "answer")
SQL["experiment_stages"] = _FULL + """
SELECT j.row_id, j.experiment, j.generated_answer, round(bs.f, 6) AS bertscore_f1,
  round(j.context_precision, 6) AS context_precision, round(j.context_recall, 6) AS context_recall,
  round(j.faithfulness, 6) AS faithfulness, round(j.answer_relevancy, 6) AS answer_relevancy
FROM judged j JOIN bs USING (row_id, experiment)"""


def _reloaded(sql: str) -> str:
    """M2: a saved generated table is read back with missing cells (the text ``nan`` too) as empty texts."""
    fresh = "coalesce(question, 'nan') AS question, coalesce(answer, 'nan') AS answer"
    assert fresh in sql
    return sql.replace(fresh, "coalesce(question, '') AS question, coalesce(answer, '') AS answer")


SQL["experiment_stages_ragas"] = _reloaded(_JUDGED) + """
SELECT row_id, experiment, round(context_precision, 6) AS context_precision, round(context_recall, 6) AS context_recall,
  round(faithfulness, 6) AS faithfulness, round(answer_relevancy, 6) AS answer_relevancy FROM judged"""
SQL["experiment_stages_bert"] = _reloaded(_GEN) + bertscore_ctes("gen", ["row_id", "experiment"], "generated_answer", "answer") + """
SELECT row_id, experiment, round(p, 6) AS bertscore_precision, round(r, 6) AS bertscore_recall,
  round(f, 6) AS bertscore_f1 FROM bs WHERE experiment = 'llama_with_rag'"""
SQL["stages_resumed"] = _FULL + """
SELECT j.row_id, j.experiment, j.generated_answer, round(bs.f, 6) AS bertscore_f1,
  round(j.context_precision, 6) AS context_precision, round(j.context_recall, 6) AS context_recall,
  round(j.faithfulness, 6) AS faithfulness, round(j.answer_relevancy, 6) AS answer_relevancy, 'ragas' AS second_run, 0 AS third_run
FROM judged j JOIN bs USING (row_id, experiment)"""


def _answers_once_sql() -> str:
    from sparqa.operators.answer import PLAIN_TEMPLATE, RAG_TEMPLATE
    context = "array_to_string(list_transform(retrieved_contexts, lambda c: substr(c, 1, 800)), ' ')"
    rag, plain = render_template(RAG_TEMPLATE, context=context, question="question"), render_template(PLAIN_TEMPLATE, question="question")
    return _GEN + f""",
p AS (SELECT row_id, experiment, generator_model, sha256(CASE WHEN use_rag THEN {rag} ELSE {plain} END) AS a FROM gen),
k AS (SELECT count(*) AS n_stored FROM (SELECT DISTINCT generator_model, a FROM p))
SELECT row_id, experiment, a AS generated_answer, n_stored, 0::BIGINT AS asked_again FROM p, k"""


SQL["answers_once"] = _answers_once_sql()
SQL["judge_batches"] = f"""
WITH q AS (SELECT row_id // 4294967296 AS conv_id, row_id, (len({tokens("coalesce(question, '')")}) + len({tokens("coalesce(answer, '')")}))::INT AS length FROM {QA_SQL}),
g AS (SELECT conv_id, list(row_id ORDER BY row_id, length) AS ids, list(length ORDER BY row_id, length) AS ls FROM q GROUP BY conv_id),
f AS (SELECT conv_id, ids, ls, list_reduce(ls, lambda acc, x: list_transform([list_min(list_filter(range(1, len(acc.used) + 1), lambda k: acc.n[k] < 3 AND acc.used[k] + x <= 60))],
          lambda i: CASE WHEN i IS NULL
          THEN {{'used': list_append(acc.used, x), 'n': list_append(acc.n, 1), 'out': list_append(acc.out, len(acc.used)::INT)}}
          ELSE {{'used': list_transform(acc.used, lambda u, k: CASE WHEN k = i THEN u + x ELSE u END),
                 'n': list_transform(acc.n, lambda m, k: CASE WHEN k = i THEN m + 1 ELSE m END), 'out': list_append(acc.out, (i - 1)::INT)}} END)[1],
        {{'used': []::INT[], 'n': []::INT[], 'out': []::INT[]}}).out AS b FROM g)
SELECT conv_id, unnest(ids) AS row_id, unnest(ls) AS length, unnest(b) AS batch FROM f"""
SQL["union_inferred"] = f"""
WITH s AS (SELECT * FROM {SCORED_SQL}),
u AS (SELECT 'WHOLE' AS label, row_id, floor(context_recall * 100)::BIGINT::DOUBLE AS score, NULL AS note FROM s
      UNION ALL SELECT 'HALVES', row_id, context_recall, CASE WHEN row_id % 2 = 0 THEN '7' END FROM s
      UNION ALL SELECT 'MARKS', row_id, CASE WHEN row_id % 4 <> 0 THEN row_id % 10 END, CASE WHEN row_id % 50 <> 1 THEN answer END FROM s)
SELECT label, row_id, score, note, CASE label WHEN 'WHOLE' THEN 'bigint,void' WHEN 'HALVES' THEN 'double,bigint' ELSE 'bigint,string' END AS own_types,
  'bigint,double,string' AS types FROM u"""
SQL["union_results"] = _JUDGED + """
SELECT upper(experiment) AS label, row_id, CASE WHEN use_rag THEN len(retrieved_contexts)::INT END AS n_contexts,
  round(answer_relevancy, 6) AS answer_relevancy, round(context_precision, 6) AS context_precision,
  round(faithfulness, 6) AS faithfulness FROM judged"""

# ================================================================== Q1-Q12
_MISS = "(context_recall IS NULL OR faithfulness IS NULL OR answer_relevancy IS NULL)"
SQL["nan_counts"] = f"""SELECT count(*) AS total_rows, count_if({_MISS})::BIGINT AS target_rows,
  count_if(context_recall IS NULL)::BIGINT AS missing_context_recall,
  count_if(faithfulness IS NULL)::BIGINT AS missing_faithfulness,
  count_if(answer_relevancy IS NULL)::BIGINT AS missing_answer_relevancy FROM {SCORED_SQL}"""
SQL["repair_select"] = f"SELECT row_id FROM {SCORED_SQL} WHERE {_MISS}"
_M4 = ["context_precision", "context_recall", "faithfulness", "answer_relevancy"]
SQL["repair_overwrite"] = f"""SELECT s.row_id, {', '.join(
    f'round(CASE WHEN {_MISS.replace("context_recall", "s.context_recall").replace("faithfulness", "s.faithfulness").replace("answer_relevancy", "s.answer_relevancy")} THEN n.{m} ELSE s.{m} END, 6) AS {m}' for m in _M4)}
FROM {SCORED_SQL} s LEFT JOIN {SECOND_SQL} n USING (row_id)"""
SQL["repair_noop"] = f"SELECT row_id, {r6(*_M4)} FROM {SCORED_SQL} WHERE NOT {_MISS}"
SQL["duplicate_keys"] = f"""SELECT sha256(question) AS question_sha, answer, experiment, count(*) AS n
FROM {SCORED_SQL} GROUP BY question, answer, experiment HAVING count(*) > 1"""


def _keyed(src: str) -> str:
    return f"""(SELECT row_id, CASE WHEN row_id % 9 = 0 THEN NULL WHEN row_id % 10 = 0 THEN question || ' #' || row_id ELSE question END AS question,
  CASE WHEN row_id % 10 = 0 AND row_id % 9 <> 0 THEN NULL ELSE answer || ' #' || row_id END AS answer,
  CASE WHEN row_id % 8 = 0 THEN NULL ELSE experiment END AS experiment, {', '.join(_M4)} FROM {src})"""


SQL["merge_metrics"] = f"""SELECT s.row_id, {', '.join(f'round(coalesce(s.{m}, n.{m}), 6) AS {m}' for m in _M4)}
FROM {_keyed(SCORED_SQL)} s LEFT JOIN {_keyed(SECOND_SQL)} n
  ON s.question IS NOT DISTINCT FROM n.question AND s.answer IS NOT DISTINCT FROM n.answer AND s.experiment IS NOT DISTINCT FROM n.experiment"""
_SCOLS = ["row_id", "question", "answer", "experiment", "generated_answer", "retrieved_contexts"] + _M4
SQL["null_counts"] = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count_if({c} IS NULL)::BIGINT AS n_missing FROM {SCORED_SQL}" for c in _SCOLS)
SQL["diagnose_missing"] = f"""SELECT count(*) AS n_missing,
  count_if(coalesce(retrieved_contexts, 'nan') IN ('[]', '', 'nan'))::BIGINT AS n_empty_contexts,
  count_if({strip("coalesce(generated_answer, '')")} = '')::BIGINT AS n_blank_answers
FROM {SCORED_SQL} WHERE answer_relevancy IS NULL"""
SQL["sample_failed"] = f"SELECT row_id, question FROM {SCORED_SQL} WHERE answer_relevancy IS NULL ORDER BY row_id LIMIT 10"

# ================================================================== P1-P4
SQL["profile_shape"] = f"SELECT count(*) AS n_rows, 10 AS n_columns FROM {SCORED_SQL}"
SQL["profile_columns"] = f"""SELECT (row_number() OVER () - 1)::INT AS position, column_name AS "column",
  CASE column_type WHEN 'BIGINT' THEN 'int' WHEN 'VARCHAR' THEN 'string' ELSE lower(column_type) END AS type
FROM (DESCRIBE SELECT * FROM {SCORED_SQL})"""
_TYPES = {"row_id": "bigint", "context_precision": "double", "context_recall": "double",
          "faithfulness": "double", "answer_relevancy": "double"}
SQL["profile_info"] = " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS \"column\", count({c}) AS non_null, '{_TYPES.get(c, 'string')}' AS type "
    f"FROM {SCORED_SQL}" for i, c in enumerate(_SCOLS))
SQL["describe_numeric"] = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", round(count({c})::DOUBLE, 6) AS count, round(avg({c}), 6) AS mean,
  round(stddev_samp({c}), 6) AS std, round(min({c})::DOUBLE, 6) AS min,
  round(quantile_cont({c}::DOUBLE, 0.25), 6) AS p25, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS p50,
  round(quantile_cont({c}::DOUBLE, 0.75), 6) AS p75, round(max({c})::DOUBLE, 6) AS max FROM {SCORED_SQL}"""
    for c in ["row_id"] + _M4)
SQL["describe_text"] = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", (SELECT count({c}) FROM {SCORED_SQL}) AS count,
  (SELECT count(DISTINCT {c}) FROM {SCORED_SQL}) AS unique,
  (SELECT v FROM (SELECT {c} AS v, count(*) AS n FROM {SCORED_SQL} WHERE {c} IS NOT NULL GROUP BY 1)
     ORDER BY n DESC, v LIMIT 1) AS top,
  (SELECT max(n) FROM (SELECT count(*) AS n FROM {SCORED_SQL} WHERE {c} IS NOT NULL GROUP BY {c})) AS freq"""
    for c in ["question", "answer", "experiment", "generated_answer", "retrieved_contexts"])

# ================================================================== R1-R3
SQL["method_averages"] = _JUDGED + """
SELECT experiment AS method, round(avg(coalesce(context_precision, 0)), 6) AS avg_context_precision,
  round(avg(coalesce(context_recall, 0)), 6) AS avg_context_recall,
  round(avg(coalesce(faithfulness, 0)), 6) AS avg_faithfulness,
  round(avg(coalesce(answer_relevancy, 0)), 6) AS avg_answer_relevancy FROM judged GROUP BY experiment"""


def pyrepr(x: str) -> str:
    """Python ``repr`` of a string for the common characters (quotes, backslash, \\n, \\r, \\t)."""
    base = f"replace(replace(replace(replace({x}, '\\', '\\\\'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')"
    return (f"CASE WHEN contains({x}, '''') AND NOT contains({x}, '\"') THEN '\"' || {base} || '\"' "
            f"ELSE '''' || replace({base}, '''', '\\''') || '''' END")


def fmt(x: str, d: int) -> str:
    return f"CASE WHEN {x} IS NULL OR isnan({x}) THEN 'nan' ELSE printf('%.{d}f', {x}) END"


def _report_sql() -> tuple[str, str]:
    from sparqa.operators import report as R
    header = "| " + " | ".join(R.METRIC_LABELS[m] for m in _M4) + " |\n"
    sections = " || ".join(f"{lit(h)} || {c} || {lit(chr(10) * 2)}" for c, h in
                           [("question", R.SECTION_HEADINGS[0][1]), ("generated_answer", R.SECTION_HEADINGS[1][1]),
                            ("answer", R.SECTION_HEADINGS[2][1])])
    scores = " || ".join(f"{lit('| ' if i == 0 else ' | ')} || {fmt(m, 4)}" for i, m in enumerate(_M4))
    rows = _JUDGED + f"""
SELECT row_id, {lit(R.QUESTION_HEADING)} || (row_id + 1)::VARCHAR || {lit(chr(10) * 2)} || {sections}
  || {lit(R.CHUNKS_HEADING)}
  || array_to_string(list_transform(retrieved_contexts, lambda c, i: i::VARCHAR || '. ' || {pyrepr('c')} || chr(10)), '')
  || {lit(R.SCORES_HEADING)} || {lit(R.SCORES_RULE)} || {lit(header)} || {scores} || {lit(R.SCORES_END)}
  AS markdown FROM judged WHERE experiment = 'llama_with_rag'"""
    avg = " || ".join(f"{lit(R.SUMMARY_AVERAGE + R.METRIC_LABELS[m] + ': ')} || {fmt(a, 2)} || chr(10)"
                      for m, a in zip(_M4, ["cp", "cr", "fa", "ar"]))
    summary = _JUDGED + f""",
a AS (SELECT experiment AS method, avg(coalesce(context_precision, 0)) AS cp, avg(coalesce(context_recall, 0)) AS cr,
  avg(coalesce(faithfulness, 0)) AS fa, avg(coalesce(answer_relevancy, 0)) AS ar FROM judged GROUP BY experiment)
SELECT method, {lit(R.SUMMARY_RULE + R.SUMMARY_METHOD)} || method || chr(10) || {lit(R.SUMMARY_RULE)}
  || {lit(R.SUMMARY_SECTIONS)} || {avg} || {lit(R.SUMMARY_TABLE)} AS summary FROM a"""
    return rows, summary


SQL["report_rows"], SQL["report_summary"] = _report_sql()


def _table_sql() -> str:
    texts = {"user_input": "question", "retrieved_contexts": "'[' || array_to_string(retrieved_contexts, ', ') || ']'",
             "response": "generated_answer", "reference": "answer"}
    esc = lambda x: rf"replace(replace(replace({x}, chr(10), '\n'), chr(13), '\r'), chr(9), '\t')"
    cells = ", ".join(f"coalesce({esc(e)}, 'None') AS {c}" for c, e in texts.items())
    cells += ", " + ", ".join(f"CASE WHEN {m} IS NULL THEN 'NaN' ELSE printf('%.6f', {m}) END AS {m}" for m in _M4)
    need = lambda m: f"greatest(max(length(regexp_extract({m}, '[.](\\d*?)0*$', 1))), 1)"
    sizes = ", ".join(f"greatest({len(c)}, max(length({c}))) AS w_{c}" for c in texts) + ", " + ", ".join(
        f"{need(m)} AS d_{m}, greatest({len(m) + 1}, max(length(regexp_extract({m}, '^-?\\d+'))) + 1 + {need(m)}, max(CASE WHEN {m} = 'NaN' THEN 3 ELSE 0 END)) AS w_{m}" for m in _M4)
    pad = lambda x, c: f"repeat(' ', CAST(w_{c} - length({x}) AS BIGINT)) || {x}"
    short = lambda m: f"(CASE WHEN c.{m} = 'NaN' THEN 'NaN' ELSE left(c.{m}, CAST(length(c.{m}) - 6 + d_{m} AS BIGINT)) END)"
    line = " || ' ' || ".join([pad(f"c.{c}", c) for c in texts] + [pad(short(m), m) for m in _M4])
    head = " || ' ' || ".join(pad(lit(c), c) for c in [*texts, *_M4])
    return _JUDGED + f""",
c AS MATERIALIZED (SELECT experiment AS method, row_id, {cells} FROM judged),
w AS (SELECT method, {sizes} FROM c GROUP BY method)
SELECT method, NULL::BIGINT AS row_id, {head} AS line FROM w
UNION ALL SELECT c.method, c.row_id, {line} AS line FROM c JOIN w USING (method)"""


SQL["report_table"] = _table_sql()

# ================================================================== D1-D4
SQL["parse_question"] = "SELECT row_id, " + ", ".join(
    f"regexp_extract(question, {lit(TEMPLATE_PATTERN)}, {i + 1}) AS {n}"
    for i, n in enumerate(["assessment", "diagnosis", "ask"])) + f" FROM {TEMPLATE_SQL}"
SQL["question_type"] = f"SELECT {qtype('question')} AS question_type, count(*) AS n FROM {TEMPLATE_SQL} GROUP BY 1"

_INSIGHT = generated_ctes(TEMPLATE_SQL) + judge_ctes("gen") + bertscore_ctes(
    "gen", ["row_id", "experiment"], "generated_answer", "answer") + f""",
ins AS (SELECT j.*, bs.f AS bertscore_f1, {qtype('j.question')} AS question_type
        FROM judged j JOIN bs USING (row_id, experiment)),
d AS (SELECT question_type, generator_model, avg(CASE WHEN use_rag THEN bertscore_f1 END) AS w,
             avg(CASE WHEN NOT use_rag THEN bertscore_f1 END) AS wo FROM ins GROUP BY ALL)"""
SQL["rag_delta"] = _INSIGHT + """
SELECT question_type, generator_model, round(w, 6) AS mean_with_rag, round(wo, 6) AS mean_without_rag,
  round(w - wo, 6) AS rag_delta FROM d"""
SQL["retrieval_quality"] = _INSIGHT + """,
q AS (SELECT question_type, avg(context_precision) AS cp, avg(context_recall) AS cr FROM ins WHERE use_rag
      GROUP BY question_type)
SELECT d.question_type, d.generator_model, round(d.w - d.wo, 6) AS rag_delta,
  round(q.cp, 6) AS mean_context_precision, round(q.cr, 6) AS mean_context_recall
FROM d LEFT JOIN q USING (question_type)"""
