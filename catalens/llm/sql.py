"""SQL of the queries that SQL can express, for DuckDB over the same tables."""

EXACT = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""

QUALITY = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
m AS (
  SELECT doc_id, len(w) AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, w
  FROM w),
starts AS (
  SELECT doc_id, unnest(range(1, greatest(len(w) - 1, 1))) AS i, w FROM m),
tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM starts),
rep AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
r AS (
  SELECT m.doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(cov.n, 0) AS n_repeat_words
  FROM m LEFT JOIN cov USING (doc_id)),
b AS (
  SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (4 * n_symbols > n_words)::BIGINT
             + 8 * (word_chars < 2 * n_words)::BIGINT + 16 * (word_chars > 25 * n_words)::BIGINT
             + 32 * (n_dup_lines >= 10)::BIGINT) AS failed_bits
  FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed_bits & 3) <> 0 AS base_failed, (failed_bits & 31) = 0 AS kept, failed_bits
FROM b
"""

MIXING = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
fill AS (
  SELECT 0 AS round, source, source_size, weight, false AS filled,
         sum(source_size) OVER ()::DOUBLE * weight / sum(weight) OVER () AS target
  FROM w
  UNION ALL
  SELECT round + 1, source, source_size, weight, f2,
         CASE WHEN f2 THEN 3.0 * source_size
              ELSE weight * ((total - coalesce(sum(CASE WHEN f2 THEN 3 * source_size END) OVER (), 0))::DOUBLE
                             / nullif(sum(CASE WHEN f2 THEN 0 ELSE weight END) OVER (), 0)) END
  FROM (SELECT *, filled OR target >= 3 * source_size AS f2, sum(source_size) OVER () AS total FROM fill WHERE round < 30)),
t AS (
  SELECT source, source_size, target,
         CASE WHEN source_size > 0 AND target > 0 THEN least(3.0, round(target / source_size, 9)) ELSE 0 END AS rate
  FROM fill WHERE round = 30),
k AS (
  SELECT doc_id, source, size, source_size, target, floor(rate)::BIGINT AS whole, rate - floor(rate) AS part,
         row_number() OVER (PARTITION BY source ORDER BY size DESC, ((doc_id % 1000003 + 1000003) % 1000003 * 7919) % 256, doc_id) - 1 AS k
  FROM d JOIN t USING (source)),
e AS (SELECT *, (floor((k + 1) * part + 0.5) - floor(k * part + 0.5))::BIGINT AS extra FROM k),
m AS (SELECT *, floor(target - sum(size * (whole + extra)) OVER (PARTITION BY source) + 0.5)::BIGINT AS missing FROM e),
u AS (
  SELECT source, size, k, missing, CASE WHEN missing > 0 THEN c ELSE -c END AS turn
  FROM (SELECT source, size, k, missing, unnest(CASE WHEN missing > 0 THEN range(whole + extra + 1, 4) ELSE range(1, whole + extra + 1) END) AS c
        FROM m WHERE size > 0 AND (missing <= 0 OR whole < 3))),
g AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY size, turn, k ROWS UNBOUNDED PRECEDING) <= abs(missing) AS moved FROM u),
i AS (SELECT *, abs(missing) - coalesce(sum(CASE WHEN moved THEN size END) OVER (PARTITION BY source), 0) AS rest FROM g),
j AS (
  SELECT source, k, moved OR row_number() OVER (PARTITION BY source ORDER BY moved, abs(rest - size), size, turn, k) = 1
                             AND abs(rest - size) < rest AS moved FROM i),
n AS (SELECT source, k, count(*) AS moves FROM j WHERE moved GROUP BY source, k),
x AS (
  SELECT doc_id, size::BIGINT AS size, source_size, target,
         (whole + extra + CASE WHEN missing > 0 THEN 1 ELSE -1 END * coalesce(moves, 0))::BIGINT AS copies
  FROM m LEFT JOIN n ON m.k = n.k AND m.source IS NOT DISTINCT FROM n.source)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM x
"""

SUBSTRINGS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM d),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS g FROM s),
r AS (SELECT doc_id, i FROM g QUALIFY doc_id > min(doc_id) OVER (PARTITION BY g)),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM r),
k AS (SELECT doc_id, list(p ORDER BY p) AS gone FROM c GROUP BY doc_id),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
t AS (SELECT doc_id, string_agg(w[i], ' ' ORDER BY i) AS t FROM p ANTI JOIN c ON p.doc_id = c.doc_id AND p.i = c.p GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN t USING (doc_id)
"""

CHAT = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
o AS (
  SELECT *, row_number() OVER w AS k, role IS DISTINCT FROM lag(role) OVER w AS opens
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY k), '')) AS loss_sha256,
       sum(length(regexp_replace(text, '([\\#/])', '..', 'g')) + 7
           + CASE WHEN opens THEN length(regexp_replace(role, '([\\#/:])', '..', 'g')) + 7 ELSE 0 END)::BIGINT AS formatted_chars
FROM o GROUP BY conv_id
"""
