"""DuckDB SQL of the corpus queries that SQL can express, written relationally and apart from the operators' methods."""

OP13 = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS tab
  FROM range(256) AS t(b)
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS bytes
  FROM conversations
), kinds AS (
  SELECT conv_id, turn, role, text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 20 AS kind
  FROM keyed, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM kinds WHERE kind <> 0
), faults AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'clean' END AS fault
  FROM damaged
), turns AS (
  SELECT conv_id, turn, role, text, fault, substr(role, 1, 1) AS initial,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), fault = 'duplicate') AS place
  FROM faults
), pairs AS (
  SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY place) AS before FROM turns
), counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (place > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM pairs GROUP BY conv_id
), moves(state, initial, target) AS (
  VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), inserts(state, target, n) AS (
  VALUES (0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0), (0, 2, 1), (1, 2, 1), (2, 3, 1), (3, 2, 1), (0, 3, 2), (1, 3, 2)
), edges AS (
  SELECT conv_id, place, state, state AS target, 4 AS price, 'D' AS letter FROM turns, (VALUES (0), (1), (2), (3)) AS q(state)
  UNION ALL
  SELECT conv_id, place, state, target, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END, 'K'
  FROM turns JOIN moves USING (initial) WHERE fault IN ('clean', 'truncated')
  UNION ALL
  SELECT conv_id, place, state, target, CASE WHEN fault = 'truncated' THEN 6 ELSE 3 END, 'R'
  FROM turns, moves WHERE moves.initial <> 's' AND fault IN ('clean', 'truncated')
), steps AS (
  SELECT conv_id, place, i.state, e.target, 3 * i.n + price AS price, repeat('I', i.n) || letter AS letters
  FROM edges e JOIN inserts i ON i.target = e.state
), paths AS (
  SELECT conv_id, 0::BIGINT AS place, 0 AS state, '000000000' AS best FROM counts
  UNION ALL
  SELECT p.conv_id, s.place, s.target, min(lpad((substr(best, 1, 9)::BIGINT + price)::VARCHAR, 9, '0') || substr(best, 10) || letters)
  FROM paths p JOIN steps s ON s.conv_id IS NOT DISTINCT FROM p.conv_id AND s.place = p.place + 1 AND s.state = p.state
  GROUP BY p.conv_id, s.place, s.target
), ended AS (
  SELECT p.conv_id, min(lpad((substr(best, 1, 9)::BIGINT + 3 * i.n)::VARCHAR, 9, '0') || substr(best, 10) || repeat('I', i.n)) AS best
  FROM paths p JOIN counts c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.n = p.place
  JOIN inserts i ON i.state = p.state AND i.target IN (0, 3)
  GROUP BY p.conv_id
), letters AS (
  SELECT conv_id, substr(best, k + 9, 1) AS letter, k, count(*) FILTER (substr(best, k + 9, 1) <> 'I') OVER (PARTITION BY conv_id ORDER BY k) AS place
  FROM (SELECT conv_id, best, unnest(range(1, length(best) - 8)) AS k FROM ended)
), left_over AS (
  SELECT l.conv_id, l.k, l.letter, t.role, t.initial, CASE WHEN l.letter = 'I' THEN '' ELSE t.text END AS text,
    row_number() OVER (PARTITION BY l.conv_id ORDER BY l.k) - 1 AS j
  FROM letters l LEFT JOIN turns t ON t.conv_id IS NOT DISTINCT FROM l.conv_id AND t.place = l.place
  WHERE l.letter <> 'D'
), numbered AS (
  SELECT *, j - max(CASE WHEN j = 0 AND letter = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS parity FROM left_over
), digests AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN parity % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k)) AS repaired_sha256
  FROM numbered GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(substr(best, 1, 9)::BIGINT, 0) AS cost, coalesce(substr(best, 10), '') AS audit,
  coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN digests d ON d.conv_id IS NOT DISTINCT FROM o.conv_id
"""

OP11 = r"""
WITH terms AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found
  FROM documents
), kept AS (
  SELECT lang, term FROM (SELECT DISTINCT lang, doc, unnest(found) AS term FROM terms) GROUP BY lang, term HAVING count(*) >= 3
), groups AS (
  SELECT DISTINCT lang, source FROM terms
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(found) AS term FROM terms) JOIN kept USING (lang, term) GROUP BY ALL
), in_lang AS (
  SELECT lang, term, sum(n) AS n FROM counts GROUP BY ALL
), sizes AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, v,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) + v) AS p
  FROM groups g JOIN kept k USING (lang) JOIN sizes USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), lang_shares AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + v) AS q FROM in_lang JOIN sizes USING (lang)
), pairs AS (
  SELECT g.lang, g.source, o.source AS item,
    coalesce((SELECT sum(((a.p - b.p) * (a.p - b.p)) // b.p) FROM shares a JOIN shares b ON b.lang = a.lang AND b.term = a.term
      WHERE a.lang = g.lang AND a.source = g.source AND b.source = o.source), 0)::BIGINT AS value
  FROM groups g JOIN groups o ON o.lang = g.lang AND o.source <> g.source
), own AS (
  SELECT lang, source, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM shares JOIN lang_shares USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank
FROM own QUALIFY rank <= 200
"""
