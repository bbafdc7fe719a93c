"""DuckDB SQL for the queries of this subpackage that SQL can express, with the same parameters."""

from __future__ import annotations

#: decontam.py: windows of ten words as strings, joined with the documents' own.
OP3 = r"""
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
items AS (
  SELECT DISTINCT id AS item_id, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS k
  FROM (SELECT id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM words WHERE side = 'b' AND len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM items),
doc_windows AS (
  SELECT id AS doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS k
  FROM (SELECT id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, sizes WHERE side = 'd')),
found AS (SELECT doc_id, i, d.size, item_id FROM doc_windows d JOIN items b ON d.k = b.k AND d.size = b.size),
hit AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY doc_id),
listed AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM found) GROUP BY doc_id)
SELECT id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(listed.n, 0) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM words LEFT JOIN hit ON id = hit.doc_id LEFT JOIN listed ON id = listed.doc_id WHERE side = 'd'
"""

#: linededup.py: every line's distinct shingles of five words (of all words where there are fewer), and all earlier lines that share one.
OP4 = r"""
WITH lines AS (
  SELECT doc_id, no - 1 AS no, line, list_filter(string_split_regex(lower(line), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents)),
tokens AS (
  SELECT DISTINCT doc_id, no, array_to_string(w[i:i + 4], ' ') AS t
  FROM (SELECT doc_id, no, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM lines WHERE len(w) > 0)),
classes AS (SELECT list(t ORDER BY t) AS ts, doc_id, no FROM tokens GROUP BY doc_id, no),
firsts AS (SELECT ts, min((doc_id, no)) AS first, len(ts) AS n, row_number() OVER (ORDER BY min((doc_id, no))) AS c FROM classes GROUP BY ts),
held AS (SELECT c, n, unnest(ts) AS t FROM firsts),
pairs AS (
  SELECT a.c AS c FROM held a JOIN held b ON a.t = b.t AND b.c < a.c
  GROUP BY a.c, b.c, a.n, b.n HAVING count(*) * 5 >= (a.n + b.n - count(*)) * 4),
gone AS (
  SELECT k.doc_id, k.no FROM classes k JOIN firsts f ON k.ts = f.ts
  WHERE (k.doc_id, k.no) > f.first OR f.c IN (SELECT c FROM pairs)),
marked AS (SELECT l.*, g.no IS NOT NULL AS goes FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.no = g.no),
made AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY no) FILTER (NOT goes) AS text, count(*) FILTER (goes) AS n_removed,
         string_agg(CAST(no AS VARCHAR), ',' ORDER BY no) FILTER (goes) AS removed
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(m.text, '') END AS text, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed
FROM documents d LEFT JOIN made m ON d.doc_id = m.doc_id
"""

#: urlrules.py: RULES, the longest first, and GLOBS as LIKE patterns.
OP5 = r"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN '.' || host LIKE '.%cheap-%' OR host LIKE '%-pills.%' OR host LIKE '%casino%' OR '.' || host LIKE '.%.ads.%' OR host LIKE '%.adserver.%' OR host LIKE '%.tracker.%'
    OR host LIKE '%poker-%' OR host LIKE '%viagra%' OR host LIKE '%torrent%' OR path LIKE '%/wp-login%' OR path LIKE '%/cart/%' OR path LIKE '%/checkout/%'
    OR path LIKE '%.exe' OR path LIKE '%.zip' OR path LIKE '%/cgi-bin/%' OR path LIKE '%/login_____%' THEN 'block'
  ELSE 'allow' END AS verdict
FROM ruled
"""

#: ngramjoin.py: all pairs that share a shingle, and the groups that links connect.
OP6 = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), ' ') AS k FROM documents),
classes AS (SELECT k, min(doc_id) AS copy_of, count(*) AS copies, string_split(k, ' ') AS w FROM texts WHERE k <> '' GROUP BY k),
held AS (
  SELECT DISTINCT copy_of, hash(array_to_string(w[i:i + 4], ' ')) AS t
  FROM (SELECT copy_of, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM classes)),
sizes AS (SELECT copy_of, count(*) AS n FROM held GROUP BY copy_of),
common AS (SELECT a.copy_of AS a, b.copy_of AS b, count(*) AS c FROM held a JOIN held b ON a.t = b.t AND a.copy_of <> b.copy_of GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON a = x.copy_of JOIN sizes y ON b = y.copy_of WHERE c * 5 >= (x.n + y.n - c) * 4),
reach AS (SELECT copy_of AS a, copy_of AS b FROM classes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
grouped AS (SELECT a, min(b) AS class_id FROM reach GROUP BY a),
linked AS (SELECT a, sum(copies) AS docs, count(*) AS n FROM links JOIN classes ON b = copy_of GROUP BY a)
SELECT t.doc_id, coalesce(class_id, t.doc_id) AS class_id, coalesce(c.copy_of, t.doc_id) AS copy_of,
       CAST(coalesce(c.copies - 1, 0) + coalesce(docs, 0) AS BIGINT) AS n_links, coalesce(l.n, 0) AS n_text_links, coalesce(class_id, t.doc_id) = t.doc_id AS chosen
FROM texts t LEFT JOIN classes c ON t.k = c.k LEFT JOIN grouped g ON c.copy_of = g.a LEFT JOIN linked l ON c.copy_of = l.a
"""

#: chat.py: FRAMES, SEGMENT and the marks.
OP8 = r"""
WITH m AS (
  SELECT conv_id, role, replace(coalesce(text, ''), '<|im_', '<| im_') AS content, regexp_replace(replace(coalesce(role, 'unknown'), '<|im_', '<| im_'), '[\x00-\x20]+', ' ', 'g') AS named,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS pos
  FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS participant FROM conversations WHERE role IS NOT NULL AND role <> 'system'),
r AS (
  SELECT m.conv_id, participant, pos, coalesce(role = participant, false) AS mine, content,
         '<|im_start|>' || CASE WHEN role = participant THEN 'assistant' WHEN role = 'system' THEN 'system'
                                ELSE 'user name=' || named END || chr(10) AS head
  FROM m JOIN p ON m.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (
  SELECT *, head || content || '<|im_end|>' || chr(10) AS piece, length(content) + 10 AS tail,
         coalesce(sum(length(head) + length(content) + 11) OVER (PARTITION BY conv_id, participant ORDER BY pos
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS begins
  FROM r)
SELECT conv_id, participant, count(*) AS n_messages, count(*) FILTER (mine) AS n_trained,
       string_agg(piece, '' ORDER BY pos) AS text,
       coalesce(string_agg(CAST(CAST(begins AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(begins + tail AS BIGINT) AS VARCHAR), ',' ORDER BY pos) FILTER (mine), '') AS mask
FROM o GROUP BY conv_id, participant
"""

#: hostrules.py: the base rules and the prior over hosts.
OP10 = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) > 1 AS twice FROM (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM base))),
again AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS p FROM windows WHERE twice) GROUP BY doc_id),
counted AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines
  FROM base LEFT JOIN again USING (doc_id)),
judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted),
hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (base_failed OR 100 * n_symbols > 20 * word_chars OR 100 * n_dup_lines > 60 * n_lines) AS f FROM judged GROUP BY source),
sums AS (SELECT sum(f) / sum(n) AS m, avg((f / n) * (f / n)) - avg(f / n) * avg(f / n) AS spread, avg(1 / n) AS inverse FROM hosts),
prior AS (
  SELECT m, CASE WHEN spread - m * (1 - m) * inverse <= 0 THEN 1e6
                 ELSE least(greatest(m * (1 - m) / (spread - m * (1 - m) * inverse) - 1, 10), 1e6) END AS s FROM sums),
bad AS (SELECT source, (f + m * s) / (n + s) > least(greatest(4.0 * m, 0.25), 0.6) AS rejected FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed,
       rejected AS host_rejected, NOT base_failed AND NOT rejected AS kept
FROM judged JOIN bad ON judged.source IS NOT DISTINCT FROM bad.source
"""

#: filteraudit.py: each document's failures as bits, and for each part, order and step the masks that the filters before it leave.
OP11 = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')), false) AS e
  FROM documents),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT
         + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * e::INT AS mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM m GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k, unnest([1, 2, 4, 8, 16]) AS b),
o AS (
  SELECT f1.k || f2.k || f3.k || f4.k || f5.k AS o, [f1.b, f2.b, f3.b, f4.b, f5.b] AS bs FROM f f1, f f2, f f3, f f4, f f5
  WHERE f1.b + f2.b + f3.b + f4.b + f5.b = 31 AND len(list_distinct([f1.b, f2.b, f3.b, f4.b, f5.b])) = 5),
s AS (SELECT o, step, bs[step] AS own, coalesce(list_sum(bs[1:step - 1]), 0)::INT AS before FROM o, range(1, 6) r(step)),
r AS (
  SELECT part, o AS filter_order, step::INT AS step, own,
         coalesce(sum(n) FILTER (mask & (before | own) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & own > 0 AND mask & before = 0), 0) AS removed,
         coalesce(sum(n) FILTER (mask & own > 0 AND mask & before > 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = own), 0) AS unique_fails,
         coalesce(sum(g) FILTER (mask & own > 0 AND mask & before = 0), 0) AS good_lost, coalesce(sum(x) FILTER (mask & own > 0 AND mask & before = 0), 0) AS toxic_lost
  FROM c, s GROUP BY part, o, step, own)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM r
"""

#: mixing.py: sources fill up in the order of size to weight; queues and the mix by running sums.
OP12 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS k FROM documents),
s AS (SELECT source, sum(size)::HUGEINT AS n, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::HUGEINT AS w FROM d GROUP BY source),
-- A source is full if it is at the level that there is when all with less size to weight are.
a AS (SELECT *, sum(n) OVER () AS all_n, sum(w) OVER up AS left_w, coalesce(sum(n) OVER (ORDER BY n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS less
      FROM s WINDOW up AS (ORDER BY n / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
b AS (SELECT *, 4 * n * left_w < w * (3 * all_n - 4 * less) AS full_ FROM a),
t AS (
  SELECT source, n, CASE WHEN full_ THEN (2 * n)::DOUBLE ELSE w::DOUBLE * (3 * all_n - 4 * coalesce(sum(n) FILTER (full_) OVER (), 0))::DOUBLE / (2 * sum(w) FILTER (NOT full_) OVER ())::DOUBLE END AS target,
         3 * all_n // 2 AS budget FROM b),
q AS (
  SELECT d.*, t.n, t.target, t.budget, row_number() OVER o AS turn, sum(size) OVER o - size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source WINDOW o AS (PARTITION BY d.source ORDER BY k, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING)),
c AS (SELECT source, turn, target, budget, start + p * n AS start, least(size, ceil(target)::HUGEINT - (start + p * n)) AS words FROM q, range(0, 2) r(p)),
m AS (
  SELECT source, turn, words, budget - (sum(words) OVER (ORDER BY least(1.0::DOUBLE, (start + words)::DOUBLE / target), source NULLS LAST, start, turn ROWS UNBOUNDED PRECEDING) - words) AS room
  FROM c WHERE words > 0),
x AS (SELECT source, turn, sum(least(words, room)) AS words FROM m WHERE room > 0 GROUP BY source, turn)
SELECT doc_id, size, n::BIGINT AS source_size, target, coalesce(words, 0)::BIGINT AS taken
FROM q LEFT JOIN x ON q.source IS NOT DISTINCT FROM x.source AND q.turn = x.turn
"""

#: chatrepair.py: the damage by CRC-32, and edits by the state after each turn, with the least cost and audit as one sortable text.
OP13 = r"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_concat([4294967295::UBIGINT], flatten(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda ch:
             [ascii(ch)::UBIGINT, 256, 256, 256, 256, 256, 256, 256, 256]))),
           lambda c, x: CASE WHEN x < 256 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END), 4294967295::UBIGINT) % 20 AS kind
  FROM conversations),
alive AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) FROM raw)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM alive),
m AS (
  SELECT conv_id, turn, role, text, pos, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE '.' END AS i,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault
  FROM placed),
ids AS (SELECT row_number() OVER () AS id, conv_id FROM (SELECT DISTINCT conv_id FROM conversations)),
n AS (SELECT id, m.* FROM m JOIN ids ON m.conv_id IS NOT DISTINCT FROM ids.conv_id),
stats AS (
  SELECT id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) AS rows_ FROM n GROUP BY id),
pairs AS (SELECT id, count(*) FILTER (p IS NOT NULL AND p || i NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT id, i, lag(i) OVER (PARTITION BY id ORDER BY pos) AS p FROM n) GROUP BY id),
-- What is inserted between two retained turns, or nothing and a turn.
ins AS (SELECT unnest(['0', '0', '0', 's', 's', 'u', 'u', 'a', 'a']) AS p, unnest(['s', 'u', 'a', 'u', 'a', 'u', 'a', 'u', 'a']) AS q, unnest(['', '', 'I', '', 'I', 'I', '', '', 'I']) AS x),
steps AS (
  SELECT id, 0::BIGINT AS pos, '0' AS state, '000000000000' AS best FROM ids
  UNION ALL
  SELECT id, pos, state, min(lpad((left(best, 12)::BIGINT + cost)::VARCHAR, 12, '0') || substr(best, 13) || letters) FROM (
    SELECT s.id, n.pos, e.state, s.best, e.cost, e.letters
    FROM steps s JOIN n ON s.id = n.id AND n.pos = s.pos + 1,
    LATERAL (
      SELECT s.state AS state, 3 AS cost, 'D' AS letters
      UNION ALL
      SELECT q, 2 * length(x) + CASE WHEN i = q THEN 0 ELSE 2 END + (fault = 'truncated')::INT, x || CASE WHEN i = q THEN 'K' ELSE 'R' END
      FROM ins WHERE ins.p = s.state AND fault NOT IN ('blank', 'duplicate') AND (i = q OR q <> 's')) e)
  GROUP BY id, pos, state),
done AS (
  SELECT st.id, min(lpad((left(best, 12)::BIGINT + 2 * length(close_))::VARCHAR, 12, '0') || substr(best, 13) || close_) AS best
  FROM (SELECT *, CASE state WHEN 's' THEN 'II' WHEN 'u' THEN 'I' ELSE '' END AS close_ FROM steps) st JOIN stats ON st.id = stats.id AND st.pos = stats.rows_ GROUP BY st.id),
audits AS (SELECT id, left(best, 12)::BIGINT AS cost, substr(best, 13) AS audit FROM done),
letters AS (
  SELECT id, k, c, sum((c <> 'I')::INT) OVER w AS pos, sum((c <> 'D')::INT) OVER w AS place
  FROM (SELECT id, unnest(string_split(audit, '')) AS c, generate_subscripts(string_split(audit, ''), 1) AS k FROM audits) WHERE c <> '' WINDOW w AS (PARTITION BY id ORDER BY k)),
kept AS (SELECT l.*, n.role, n.text, max((place = 1 AND c = 'K' AND n.i = 's')::INT) OVER (PARTITION BY l.id) AS framed FROM letters l LEFT JOIN n ON l.id = n.id AND l.pos = n.pos AND l.c <> 'I' WHERE c <> 'D'),
hashes AS (
  SELECT id, sha256(string_agg(CASE WHEN c = 'K' THEN role WHEN (place - framed) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN c = 'I' THEN '' ELSE text END, chr(10) ORDER BY k)) AS h
  FROM kept GROUP BY id)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM ids LEFT JOIN stats USING (id) LEFT JOIN pairs USING (id) LEFT JOIN audits USING (id) LEFT JOIN hashes USING (id)
"""
