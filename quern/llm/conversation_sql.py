"""SQL of the conversation repair, by a recursion over rows."""

from quern.llm.interval_sql import CRC_TABLE, crc32_sql

OP11_SQL = rf"""
WITH RECURSIVE {CRC_TABLE}, r AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS hit
  FROM conversations, crc_table
), d AS (
  SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
         CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN hit = 3 THEN 2 ELSE 1 END)) AS copy
  FROM r WHERE hit <> 0
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM d
), f AS (
  SELECT *, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault
  FROM n
), inserts(q, cost, audit, made, p) AS (
  VALUES (0, 0, '', '', 0), (0, 5, 'I', chr(10) || 'user:', 2), (0, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 3),
         (1, 0, '', '', 1), (1, 5, 'I', chr(10) || 'user:', 2), (1, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 3),
         (2, 0, '', '', 2), (2, 5, 'I', chr(10) || 'assistant:', 3), (3, 0, '', '', 3), (3, 5, 'I', chr(10) || 'user:', 2)
), acts(p, initial, role, act, cost, q) AS (
  VALUES (0, 's', NULL, 'K', 0, 1), (0, 'u', NULL, 'K', 0, 2), (1, 'u', NULL, 'K', 0, 2), (3, 'u', NULL, 'K', 0, 2), (2, 'a', NULL, 'K', 0, 3),
         (0, NULL, 'user', 'R', 1, 2), (1, NULL, 'user', 'R', 1, 2), (3, NULL, 'user', 'R', 1, 2), (2, NULL, 'assistant', 'R', 1, 3),
         (0, NULL, NULL, 'D', 2, 0), (1, NULL, NULL, 'D', 2, 1), (2, NULL, NULL, 'D', 2, 2), (3, NULL, NULL, 'D', 2, 3)
), w AS (
  SELECT DISTINCT conv_id, 0 AS i, 0 AS q, struct_pack(cost := 0, audit := '', made := '') AS best FROM d
  UNION ALL
  SELECT w.conv_id, w.i + 1, acts.q, min(struct_pack(
      cost := w.best.cost + inserts.cost + acts.cost + CASE WHEN fault = 'truncated' AND act <> 'D' THEN 5 ELSE 0 END,
      audit := w.best.audit || inserts.audit || act,
      made := w.best.made || inserts.made || CASE WHEN act = 'D' THEN '' ELSE chr(10) || coalesce(acts.role, f.role) || ':' || f.text END))
  FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.i + 1 JOIN inserts ON inserts.q = w.q
    JOIN acts ON acts.p = inserts.p AND (acts.initial IS NULL OR acts.initial = f.initial) AND (act = 'D' OR fault NOT IN ('blank', 'duplicate'))
  GROUP BY w.conv_id, w.i + 1, acts.q
), e AS (
  SELECT conv_id, min(struct_pack(cost := best.cost + CASE q WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 0 END, audit := best.audit || CASE q WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END,
         made := best.made || CASE q WHEN 1 THEN chr(10) || 'user:' || chr(10) || 'assistant:' WHEN 2 THEN chr(10) || 'assistant:' ELSE '' END)) AS best
  FROM w WHERE i = (SELECT count(*) FROM d WHERE d.conv_id IS NOT DISTINCT FROM w.conv_id) GROUP BY conv_id
), a AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id
), ids AS (
  SELECT DISTINCT conv_id FROM conversations
)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit, sha256(substr(coalesce(best.made, ''), 2)) AS repaired_sha256
FROM ids LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM ids.conv_id
"""
