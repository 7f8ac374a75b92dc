"""DuckDB SQL for the queries of this package that SQL can express."""

OP1 = r"""
WITH t AS (
  SELECT conv_id, turn, CASE WHEN lower(trim(role, ' ')) IN ('human', 'prompter') THEN 'user' WHEN lower(trim(role, ' ')) IN ('gpt', 'bot', 'model', 'chatbot') THEN 'assistant' ELSE coalesce(role, '') END AS role,
         coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7::BIGINT, 0::BIGINT, 'user', '</s>[INST] ok [/INST]'), (-7::BIGINT, 1::BIGINT, 'assistant', '</s>[INST] ok [/INST]'))
), e AS (
  SELECT *, regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\]|/?ROLE\])', '\1\2\\\3', 'g') AS r,
         regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|/?ROLE\])', '\1\2\\\3', 'g') AS x FROM t
), p AS (
  SELECT *, CASE role WHEN 'user' THEN '<s>[INST] ' || x || ' [/INST]</s>' WHEN 'assistant' THEN '<s>' || x || '</s>' ELSE '<s>[ROLE]' || r || '[/ROLE]' || x || '</s>' END AS piece FROM e
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(piece))::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
"""

OP6 = r"""
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
w AS (SELECT source, n, pow(n::DOUBLE, 0.5) AS w FROM n),
r AS (SELECT source, w * ((SELECT sum(n) FROM w)::DOUBLE / (SELECT sum(w::DECIMAL(38, 9))::DOUBLE FROM w)) / n AS rate FROM w),
u AS (SELECT d.*, rate, (('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
      FROM documents d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
pmf AS (SELECT source, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p FROM r, range(0, 100) AS t(k)),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM pmf)
SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, c.k::INTEGER AS copy
FROM u JOIN cdf c ON u.source IS NOT DISTINCT FROM c.source AND c.c < u.u
"""

_OP8_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP8 = rf"""
WITH d AS (SELECT doc_id, {_OP8_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_OP8_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
       FROM b, range(1, 100000) AS t(i) WHERE len(w) > 0 AND i <= len(w) - least(len(w), 10) + 1),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), sizes WHERE i + size - 1 <= len(w)),
m AS (SELECT dw.doc_id, dw.i, dw.size, bw.item_id FROM dw JOIN bw USING (size, win)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""

OP7 = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM t WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
r(id, other) AS (SELECT u, v FROM e UNION SELECT r.id, e.v FROM r JOIN e ON r.other = e.u),
m AS (SELECT id, least(id, min(other)) AS component FROM r GROUP BY id)
SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(component, t.doc_id) AS component_id, coalesce(component, t.doc_id) = t.doc_id AS kept
FROM t LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.id = t.doc_id
"""

OP10 = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLES = {"op1_chat_formatting": OP1, "op6_mixing": OP6, "op7_minhash_near_dedup": OP7, "op8_decontamination": OP8, "op10_exact_top_k": OP10}
