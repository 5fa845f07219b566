"""DuckDB SQL for the queries of this subpackage that SQL can express, stated apart from the operators.

Not expressible: scores and spans of trained models (op1, op3), tokens and
packing (op8), the schedule (op5), CRC-32 (op7).
"""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

OP2 = """
WITH p AS (SELECT page_id, COALESCE(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS hex FROM p),
bits AS (
  SELECT page_id, payload_bytes, hex,
         list_aggregate(list_transform(string_split(hex, ''), lambda c: lpad(bin(strpos('0123456789abcdef', c) - 1), 4, '0')), 'string_agg', '') AS b
  FROM d),
e AS (
  SELECT page_id, payload_bytes, hex,
         list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           16 * CAST(substr(b, i * 5 + 1, 1) AS INT) + 8 * CAST(substr(b, i * 5 + 2, 1) AS INT) + 4 * CAST(substr(b, i * 5 + 3, 1) AS INT)
           + 2 * CAST(substr(b, i * 5 + 4, 1) AS INT) + CAST(substr(b, i * 5 + 5, 1) AS INT) + 1, 1)), 'string_agg', '') AS payload_digest
  FROM bits),
f AS (SELECT *, MIN(page_id) OVER (PARTITION BY hex) AS first FROM e)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS NULL OR page_id = first THEN NULL ELSE first END AS refers_to
FROM f
"""

OP4 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(words, i + 1, i + 5), ' ') AS sh FROM w, UNNEST(range(greatest(1, len(words) - 4))) AS t(i) WHERE len(words) > 0),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, COUNT(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= 75 * (x.n + y.n - k)),
r(u, v) AS (SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON l.u = r.v),
m AS (SELECT u, MIN(v) AS v FROM r GROUP BY u)
SELECT d.doc_id, CAST(COALESCE(n.n, 0) AS BIGINT) AS n_shingles, LEAST(d.doc_id, COALESCE(m.v, d.doc_id)) AS component_id,
       d.doc_id = LEAST(d.doc_id, COALESCE(m.v, d.doc_id)) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.u = d.doc_id
"""

_METRICS = {
    "symbols": "1000 * n_symbols // greatest(word_chars, 1)",
    "word_length": "100 * word_chars // greatest(n_words, 1)",
    "repeated_lines": "1000 * n_dup_lines // greatest(n_lines, 1)",
}


def _fence(keys: str, name: str) -> str:
    """Sketch quantiles of each group."""
    by = f"PARTITION BY {keys}, metric" if keys else "PARTITION BY metric"
    group = f"{keys}, metric" if keys else "metric"
    at = ", ".join(f"MIN(CASE WHEN upto >= {p / 100} * docs THEN place END) AS q{p}" for p in (25, 50, 75, 97, 99))
    return f"""
{name} AS (SELECT {group}, MAX(docs) AS docs, {at}
  FROM (SELECT {group}, place, SUM(COUNT(*)) OVER ({by} ORDER BY place) AS upto, SUM(COUNT(*)) OVER ({by}) AS docs FROM place GROUP BY {group}, place) t GROUP BY {group})"""


def _end(q: str) -> str:
    """The last value that shares the place ``q`` of the sketch."""
    return f"({q} + (1::BIGINT << greatest(length(bin({q})) - 7, 0)) - 1)"


OP6 = rf"""
WITH w AS (SELECT row_number() OVER () AS row, doc_id, lang, source, COALESCE(text, '') AS text, regexp_extract_all(COALESCE(text, ''), '{_WORD}') AS words FROM documents),
g AS (SELECT row, i, array_to_string(list_slice(words, i + 1, i + 5), ' ') AS sh FROM w, UNNEST(range(greatest(0, len(words) - 4))) AS t(i)),
h AS (SELECT row, i, COUNT(*) OVER (PARTITION BY row, sh) AS k FROM g),
rep AS (SELECT row, COUNT(DISTINCT i + j) AS n FROM h, UNNEST(range(5)) AS t(j) WHERE k > 1 GROUP BY row),
lines AS (SELECT row, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM w),
st AS (
  SELECT w.row, w.doc_id, w.lang, w.source, CAST(len(w.words) AS BIGINT) AS n_words, CAST(COALESCE(list_sum(list_transform(w.words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(w.text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(COALESCE(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w JOIN lines USING (row) LEFT JOIN rep USING (row)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM st),
v AS ({" UNION ALL ".join(f"SELECT row, lang, source, base_failed, '{m}' AS metric, CAST({e} AS BIGINT) AS value FROM f" for m, e in _METRICS.items())}),
place AS (SELECT COALESCE(lang, chr(1)) AS lang, COALESCE(source, chr(1)) AS source, metric, value - value % (1::BIGINT << greatest(length(bin(value)) - 7, 0)) AS place FROM v WHERE NOT base_failed),
{_fence("lang, source", "q_source")},
{_fence("lang", "q_lang")},
{_fence("", "q_all")},
pick AS (
  SELECT v.row, v.metric, v.value, CASE WHEN s.docs IS NULL THEN NULL WHEN s.docs >= 50 THEN 'source' WHEN l.docs >= 50 THEN 'language' ELSE 'all' END AS sketch,
         CASE WHEN s.docs >= 50 THEN {{p: s.q25, q: s.q50, r: s.q75, t: s.q97, u: s.q99}} WHEN l.docs >= 50 THEN {{p: l.q25, q: l.q50, r: l.q75, t: l.q97, u: l.q99}} ELSE {{p: a.q25, q: a.q50, r: a.q75, t: a.q97, u: a.q99}} END AS z
  FROM v LEFT JOIN q_source s ON s.lang = COALESCE(v.lang, chr(1)) AND s.source = COALESCE(v.source, chr(1)) AND s.metric = v.metric
  LEFT JOIN q_lang l ON l.lang = COALESCE(v.lang, chr(1)) AND l.metric = v.metric LEFT JOIN q_all a ON a.metric = v.metric),
inside AS (
  SELECT row, MAX(sketch) AS sketch, bool_and(COALESCE(CASE metric WHEN 'word_length' THEN value BETWEEN z.q - 10 * ({_end("z.r")} - z.p) AND {_end("z.q")} + 10 * ({_end("z.r")} - z.p) WHEN 'symbols' THEN value <= {_end("z.t")} ELSE value <= {_end("z.u")} END, TRUE)) AS ok
  FROM pick GROUP BY row)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ok AS kept, inside.sketch FROM f JOIN inside USING (row)
"""

OP9 = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS n FROM e),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.93),
r(u, v) AS (SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON l.u = r.v),
m AS (SELECT u, MIN(v) AS v FROM r GROUP BY u),
k AS (SELECT u, COUNT(*) AS n FROM l GROUP BY u)
SELECT x.vec_id, CAST(COALESCE(k.n, 0) AS BIGINT) AS n_links, LEAST(x.vec_id, COALESCE(m.v, x.vec_id)) AS component_id, x.vec_id = LEAST(x.vec_id, COALESCE(m.v, x.vec_id)) AS kept
FROM embeddings x LEFT JOIN k ON k.u = x.vec_id LEFT JOIN m ON m.u = x.vec_id
"""

OP10 = r"""
WITH c AS (
  SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (
  SELECT *, 4 + length(replace(replace(role, '%', '%25'), chr(10), '%0A')) + 2 + length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')) + 9 AS n FROM c)
SELECT conv_id, COUNT(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(COALESCE(SUM(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
       sha256(COALESCE(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(SUM(n) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""

ORACLE_SQL = {
    "op2_warc": OP2,
    "op4_near_duplicates": OP4,
    "op6_quality": OP6,
    "op9_near_vectors": OP9,
    "op10_chat": OP10,
}
