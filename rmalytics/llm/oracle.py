"""DuckDB SQL of the queries that SQL can express, written apart from the operators."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

QUALITY = r"""
WITH d AS (
  -- every language has a reference, and so has the null one
  SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, '') AS lang, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
b AS (
  SELECT rid, doc_id, lang, t, w, len(w) AS n,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines
  FROM d
),
win AS (
  SELECT rid, i, w[i] || chr(32) || w[i + 1] || chr(32) || w[i + 2] AS g
  FROM (SELECT rid, w, unnest(range(1, n - 1)) AS i FROM b WHERE n >= 3)
),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
rep AS (
  SELECT rid, count(DISTINCT p) AS k
  FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid
),
cls AS (
  SELECT rid, lang, n, w,
         [length(regexp_replace(t, '[^a-z]', '', 'g')), length(regexp_replace(t, '[^\x20\x09-\x0D]', '', 'g')),
          length(regexp_replace(t, '[^A-Z]', '', 'g')), length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')),
          length(regexp_replace(t, '[^0-9]', '', 'g')),
          length(regexp_replace(t, '[^\x21-\x7E]|[a-zA-Z0-9#*$%&|<>]', '', 'g')),
          length(regexp_replace(regexp_replace(t, '[\x00-\x7F]', '', 'g'), '[^\p{L}\p{M}]', '', 'g'))] AS c,
         length(t) AS chars
  FROM b
),
cls2 AS (SELECT rid, lang, n, w, chars, list_append(c, chars - list_sum(c)) AS c FROM cls),
pos AS (SELECT unnest(range(1, 9)) AS j),
langs AS (SELECT DISTINCT lang FROM d),
refc AS (SELECT lang, j, sum(c[j]) AS q FROM cls2 JOIN langs USING (lang), pos GROUP BY lang, j),
wc AS (
  SELECT lang, x, count(*) AS k FROM (SELECT lang, unnest(w) AS x FROM cls2 JOIN langs USING (lang)) GROUP BY lang, x
),
top AS (
  SELECT lang, x, k FROM (
    SELECT lang, x, k, row_number() OVER (PARTITION BY lang ORDER BY k DESC, x) AS r FROM wc WHERE length(x) <= 5
  ) WHERE r <= 24
),
tot AS (SELECT lang, sum(k) AS k FROM wc GROUP BY lang),
-- histograms as rows: document, cell, count, reference count
cc AS (SELECT rid, j, c[j] AS p, q FROM cls2 JOIN langs USING (lang), pos JOIN refc USING (j) WHERE refc.lang = cls2.lang AND chars >= 200),
dw AS (
  SELECT rid, x, count(*) AS p FROM (SELECT rid, lang, unnest(w) AS x FROM cls2 WHERE n >= 100) u
  JOIN top USING (lang, x) GROUP BY rid, x
),
wt AS (
  SELECT rid, x, coalesce(dw.p, 0) AS p, k AS q FROM (SELECT rid, lang FROM cls2 WHERE n >= 100) v
  JOIN top USING (lang) LEFT JOIN dw USING (rid, x)
),
ww AS (
  SELECT rid, p, q FROM wt
  UNION ALL
  SELECT v.rid, v.n - coalesce(sum(wt.p), 0), any_value(tot.k) - coalesce(sum(wt.q), 0)
  FROM (SELECT rid, lang, n FROM cls2 WHERE n >= 100) v JOIN tot USING (lang) LEFT JOIN wt ON wt.rid = v.rid GROUP BY v.rid, v.n
),
jsd AS (
  SELECT kind, rid, sqrt(greatest(sum((CASE WHEN a > 0 THEN a * log2(a / ((a + b) / 2)) ELSE 0 END
                                     + CASE WHEN b > 0 THEN b * log2(b / ((a + b) / 2)) ELSE 0 END) / 2), 0)) AS d
  FROM (
    SELECT kind, rid, p / sum(p) OVER (PARTITION BY kind, rid) AS a, q / sum(q) OVER (PARTITION BY kind, rid) AS b
    FROM (SELECT 'c' AS kind, rid, p, q FROM cc UNION ALL SELECT 'w', rid, p, q FROM ww)
  ) GROUP BY kind, rid
)
SELECT b.doc_id, CAST(b.n AS BIGINT) AS n_words, b.word_chars, b.n_symbols,
       CAST(len(b.lines) - len(list_distinct(b.lines)) AS BIGINT) AS n_dup_lines,
       CAST(coalesce(rep.k, 0) AS BIGINT) AS n_repeat_words,
       (b.n < 50 OR 100 * coalesce(rep.k, 0) > 50 * b.n) AS base_failed,
       NOT (b.n < 50 OR 100 * coalesce(rep.k, 0) > 50 * b.n)
         AND coalesce(jc.d, 0) <= 0.35 AND coalesce(jw.d, 0) <= 0.45 AS kept
FROM b LEFT JOIN rep USING (rid)
LEFT JOIN jsd jc ON jc.rid = b.rid AND jc.kind = 'c'
LEFT JOIN jsd jw ON jw.rid = b.rid AND jw.kind = 'w'
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                               1 + ((CAST('0x' || substr(x, 1 + 5 * (k // 4), 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31), 1)
                        FOR k IN range(0, 32)], '') AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM d
"""

TOP_K = """
WITH v AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id AND len(v.e) = len(q.e)
),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 5
"""

EXACT = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256
FROM d JOIN g USING (t)
"""

MIDDLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
         sha256('7:' || doc_id) AS h
  FROM documents
),
k AS (
  SELECT doc_id, t, u, len(u) AS n, [CAST('0x' || substr(h, 1 + 8 * i, 8) AS BIGINT) FOR i IN range(0, 4)] AS h FROM d
),
c AS (
  SELECT doc_id, t, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b, u,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100 THEN 'plain'
              WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM k
),
p AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS x, array_to_string(u[a + 1:b], '') AS y, array_to_string(u[b + 1:], '') AS z FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(x) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(y) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y
                        WHEN 'spm' THEN '<S>' || z || '<P>' || x || '<M>' || y ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""

NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
s AS (
  SELECT q.vec_id AS anchor_id, v.vec_id, q.label = v.label AS same, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id AND len(v.e) = len(q.e)
),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
),
n AS (
  SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS k
  FROM p JOIN s USING (anchor_id)
  WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
)
SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE k <= 3
"""
