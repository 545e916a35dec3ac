"""DuckDB SQL for the queries that SQL can express."""

OP9 = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), i AS (
  SELECT doc_id, s AS start, array_to_string(ws[s:s + 19], ' ') AS k FROM w, unnest(generate_series(1, len(ws) - 19)) t(s) WHERE len(ws) >= 20
), later AS (
  SELECT doc_id, start FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, start) AS r FROM i) WHERE r > 1
), gone AS (
  SELECT DISTINCT doc_id, start + o AS at FROM later, range(20) t(o)
), tok AS (
  SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS at FROM w
), kept AS (
  SELECT t.doc_id, count(g.at) AS n_removed, string_agg(t.word, ' ' ORDER BY t.at) FILTER (g.at IS NULL) AS text
  FROM tok t LEFT JOIN gone g ON t.doc_id = g.doc_id AND t.at = g.at GROUP BY 1
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

ORACLES = {"op9_substring_dedup": OP9}

OP6 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, k FROM (
    SELECT doc_id, array_to_string(ws[i:i + 2], ' ') AS k FROM w, unnest(generate_series(1, greatest(1, len(ws) - 2))) t(i) WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
f AS (SELECT k FROM s GROUP BY k HAVING count(*) > 1),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN f USING (k) JOIN s b USING (k) WHERE a.doc_id < b.doc_id GROUP BY 1, 2
), l AS MATERIALIZED (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)
), e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, c) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.c, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT id, min(c) AS c FROM r GROUP BY 1) c ON c.id = w.doc_id
"""

ORACLES["op6_jaccard_join"] = OP6

OP10 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h) AS n, sha256(h) AS d, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM q
"""

ORACLES["op10_warc"] = OP10

OP5 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(16 + length(role) + length(replace(replace(replace(text, '\', '\\'), '<turn', '\lturn'), '</turn', '\l/turn')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

OP7 = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda y: y IS NULL OR NOT isfinite(y)), true) AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0
), n AS MATERIALIZED (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS r FROM v),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM n a, n b WHERE a.vec_id < b.vec_id AND list_dot_product(a.x, b.x) / (a.r * b.r) >= 0.95),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, c) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id)
SELECT vec_id, coalesce(k.n, 0)::BIGINT AS n_links, coalesce(c.c, vec_id) AS component_id, coalesce(c.c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY 1) k USING (vec_id) LEFT JOIN (SELECT id AS vec_id, min(c) AS c FROM r GROUP BY 1) c USING (vec_id)
"""

ORACLES |= {"op5_chat_format": OP5, "op7_vector_dedup": OP7}
