"""DuckDB SQL for the queries of this package that SQL can express."""

MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::BIGINT AS size
  FROM documents
), keyed AS (
  SELECT doc_id, source, size,
         -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || chr(10) || t), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
         / CASE WHEN length(t) / greatest(size, 1)::DOUBLE BETWEEN 3 AND 13 THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END AS key
  FROM sized
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM totals
), weighed AS (
  SELECT *, ([3.0, 1.0, 2.0])[((rk - 1) % 3 + 1)::INT]::DOUBLE AS w, source_size::DOUBLE * 2 AS cap FROM ranked
), filled AS (
  SELECT *, cap / w AS fill,
         ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER before, 0)) / ((sum(w) OVER ()) - coalesce(sum(w) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), goals AS (
  SELECT source, source_size, least(cap, coalesce(w * (arg_min(level, (fill, rk)) FILTER (fill > level) OVER ()), cap)) AS target FROM filled
), placed AS (
  SELECT k.*, g.source_size, g.target, floor(g.target + 0.5)::BIGINT AS goal,
         coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM keyed k JOIN goals g ON k.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
       ((goal // greatest(source_size, 1)) * size
        + greatest(0, least(size, goal - (goal // greatest(source_size, 1)) * greatest(source_size, 1) - before)))::BIGINT AS taken
FROM placed
"""

CHAT = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '\\|<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<s>|</s>|<role>|</role>|<text>')) AS body FROM said
), sized AS (
  SELECT *, body + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
    ELSE 19 + length(role) + len(regexp_extract_all(role, '\\|<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<s>|</s>|<role>|</role>|<text>')) END AS chars FROM escaped
), walked AS (
  SELECT conv_id, role, row_number() OVER turns - 1 AS nth, last_value(CASE WHEN role IN ('user', 'assistant') THEN role END IGNORE NULLS) OVER earlier AS spoke,
         coalesce(bool_or(role = 'system') OVER earlier, false) AS briefed, last_value(CASE WHEN role IN ('user', 'assistant') THEN role END IGNORE NULLS) OVER every AS final
  FROM said WINDOW turns AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text), earlier AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    every AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), machine AS (
  SELECT conv_id, min(nth) FILTER (NOT CASE WHEN spoke = 'user' THEN role = 'assistant' WHEN spoke = 'assistant' OR briefed THEN role = 'user' ELSE role IN ('system', 'user') END)::INT AS error_at,
         any_value(final) AS final FROM walked GROUP BY conv_id
), chats AS (
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
)
SELECT chats.*, error_at IS NULL AND coalesce(final = 'assistant', false) AS valid, error_at FROM chats JOIN machine ON chats.conv_id IS NOT DISTINCT FROM machine.conv_id
"""

VECTORS = r"""
WITH RECURSIVE fine AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95
), reach AS (
  SELECT a AS vec_id, least(a, b) AS root FROM links
  UNION SELECT l.a, r.root FROM reach r JOIN links l ON l.b = r.vec_id WHERE r.root < l.a
), roots AS (SELECT vec_id, min(root) AS root FROM reach GROUP BY vec_id), counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(r.root, e.vec_id)) AS component_id, coalesce(r.root, e.vec_id) >= e.vec_id AS kept
FROM embeddings e LEFT JOIN counts c ON c.a = e.vec_id LEFT JOIN roots r ON r.vec_id = e.vec_id
"""

NGRAM_JOIN = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle FROM texts
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM (SELECT a, b, common, x.n + y.n - common AS either FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b) WHERE 100 * common >= 80 * either
), ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT a AS doc_id, least(a, b) AS root FROM ways
  UNION SELECT w.a, r.root FROM reach r JOIN ways w ON w.b = r.doc_id WHERE r.root < w.a
), roots AS (SELECT doc_id, min(root) AS root FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(root, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN roots USING (doc_id)
"""
