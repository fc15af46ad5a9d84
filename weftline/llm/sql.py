"""Check SQL (DuckDB) of the training-data queries."""

from __future__ import annotations

from weftline.llm.licenses import NOTICES, PHRASES

MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
per_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, source_size * 3 AS cap,
         sum(source_size) OVER () AS total FROM per_source),
-- the level of a weight unit: the first k sources by cap / weight stay at their caps, the others share the rest
tried AS (
  SELECT a.source, a.cap / a.w AS edge,
         (any_value(a.total) - coalesce(sum(b.cap) FILTER (b.cap / b.w < a.cap / a.w OR (b.cap / b.w = a.cap / a.w AND (b.source < a.source OR (a.source IS NULL AND b.source IS NOT NULL)))), 0))::DOUBLE AS left_over,
         any_value(a.w) * 0 + sum(b.w) FILTER (NOT (b.cap / b.w < a.cap / a.w OR (b.cap / b.w = a.cap / a.w AND coalesce(b.source < a.source OR (a.source IS NULL AND b.source IS NOT NULL), false)))) AS ws,
         a.cap, a.w
  FROM weighted a, weighted b GROUP BY a.source, a.cap, a.w),
level AS (SELECT left_over, ws FROM tried WHERE left_over * w <= cap * ws ORDER BY edge, source NULLS LAST LIMIT 1),
targets AS (
  SELECT source, source_size, least(cap::DOUBLE, w * (SELECT left_over FROM level) / (SELECT ws FROM level)) AS target FROM weighted),
placed AS (
  SELECT s.*, row_number() OVER (PARTITION BY source ORDER BY size, md5(doc_id::VARCHAR)) AS k FROM sized s),
drawn AS (
  SELECT doc_id, size, source_size, target, k,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS ratio,
         floor(('0x' || substr(md5('20|' || CASE WHEN p.source IS NULL THEN '1' ELSE '0' || p.source END), 1, 8))::BIGINT / 65536) / 65536 AS u
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (floor(k * ratio + u) - floor((k - 1) * ratio + u))::BIGINT * size AS taken FROM drawn
"""

QUALITY_RULES = r"""
WITH base AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
wins AS (
  SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM base)),
twice AS (SELECT doc_id, win FROM wins GROUP BY ALL HAVING count(*) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM wins JOIN twice USING (doc_id, win), range(0, 5) r(k) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS again
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM base)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
feats AS (
  SELECT b.doc_id, coalesce(lang, '') || CASE WHEN lang IS NULL THEN '1' ELSE '0' END AS lang,
         coalesce(source, '') || CASE WHEN source IS NULL THEN '1' ELSE '0' END AS source,
         len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(again, 0)::BIGINT AS n_dup_lines,
         coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM base b LEFT JOIN covered c USING (doc_id) LEFT JOIN lines l USING (doc_id)),
marked AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         n_symbols * 1000000 // greatest(word_chars, 1) AS m1, n_dup_lines * 1000000 // greatest(n_lines, 1) AS m2,
         word_chars * 1000 // greatest(n_words, 1) AS m3 FROM feats),
entries AS (
  SELECT lang, source, metric, CASE WHEN v < 32 THEN v ELSE (length(bin(v)) - 5) * 16 + (v >> (length(bin(v)) - 5)) END AS bucket
  FROM (SELECT lang, source, unnest([1, 2, 3]) AS metric, unnest([m1, m2, m3]) AS v FROM marked WHERE NOT base_failed)),
sketch AS (
  SELECT lang, source, metric, bucket, count(*) AS n, grouping(lang, source) AS lv FROM entries
  GROUP BY GROUPING SETS ((lang, source, metric, bucket), (lang, metric, bucket), (metric, bucket))),
sums AS (
  SELECT *, sum(n) OVER (PARTITION BY lv, lang, source, metric ORDER BY bucket) AS upto,
         sum(n) OVER (PARTITION BY lv, lang, source, metric) AS al FROM sketch),
quant AS (
  SELECT lv, lang, source, metric, max(al) AS al, min(bucket) FILTER (upto * 10 >= al) AS b1, min(bucket) FILTER (upto * 10 >= al * 5) AS b5,
         min(bucket) FILTER (upto * 10 >= al * 9) + 1 AS b9 FROM sums GROUP BY lv, lang, source, metric),
q AS (
  SELECT lv, lang, source, metric, al, CASE WHEN b1 < 32 THEN b1 ELSE (b1 % 16 + 16) << (b1 // 16 - 1)::INT END AS q1,
         CASE WHEN b5 < 32 THEN b5 ELSE (b5 % 16 + 16) << (b5 // 16 - 1)::INT END AS q5,
         CASE WHEN b5 + 1 < 32 THEN b5 + 1 ELSE ((b5 + 1) % 16 + 16) << ((b5 + 1) // 16 - 1)::INT END - 1 AS q6,
         CASE WHEN b9 < 32 THEN b9 ELSE (b9 % 16 + 16) << (b9 // 16 - 1)::INT END - 1 AS q9 FROM quant),
langs AS (
  SELECT l.lang, l.metric, (l.al * l.q1 + 50 * c.q1) // (l.al + 50) AS q1, (l.al * l.q5 + 50 * c.q5) // (l.al + 50) AS q5, (l.al * l.q6 + 50 * c.q6) // (l.al + 50) AS q6, (l.al * l.q9 + 50 * c.q9) // (l.al + 50) AS q9
  FROM q l JOIN q c ON c.lv = 3 AND c.metric = l.metric WHERE l.lv = 1),
drawn AS (
  SELECT o.lang, o.source, o.metric, (o.al * o.q1 + 50 * l.q1) // (o.al + 50) AS q1, (o.al * o.q5 + 50 * l.q5) // (o.al + 50) AS q5, (o.al * o.q6 + 50 * l.q6) // (o.al + 50) AS q6, (o.al * o.q9 + 50 * l.q9) // (o.al + 50) AS q9
  FROM q o JOIN langs l ON l.lang = o.lang AND l.metric = o.metric WHERE o.lv = 0),
limits AS (SELECT lang, source, metric, q1 - 3 * (q6 - q1) AS lo, q9 + 3 * (q9 - q5) AS hi FROM drawn),
verdict AS (
  SELECT lang, source, max(lo) FILTER (metric = 1) AS l1, max(hi) FILTER (metric = 1) AS h1, max(lo) FILTER (metric = 2) AS l2,
         max(hi) FILTER (metric = 2) AS h2, max(lo) FILTER (metric = 3) AS l3, max(hi) FILTER (metric = 3) AS h3 FROM limits GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(m1 >= l1 AND m2 >= l2 AND m3 >= l3 AND (m1 <= h1 OR n_symbols <= 1) AND (m2 <= h2 OR n_dup_lines <= 1) AND m3 <= h3, false) AS kept
FROM marked LEFT JOIN verdict USING (lang, source)
"""

_TEMPLATES = ", ".join(f"({t}, '{label}', '{phrase}')" for t, (label, phrase) in enumerate(PHRASES + NOTICES))

_TELLS = "(regexp_matches(x, '^[0-9]') OR x IN ('affero', 'lesser', 'nc', 'nd', 'noncommercial', 'noderivs', 'sa', 'sharealike'))"

LICENSES = rf"""
WITH templates(template, label, phrase) AS (VALUES {_TEMPLATES}),
worded_templates AS (SELECT template, label, string_split(phrase, ' ') AS w, len(string_split(phrase, ' ')) AS size FROM templates),
shape AS (
  SELECT template, array_to_string(list_filter(w, lambda x: {_TELLS}), ' ') AS told,
         list_filter(range(size), lambda k: list_transform(w, lambda x: {_TELLS})[k + 1]) AS tj FROM worded_templates),
pos AS (SELECT template, label, size, j - 1 AS j, w[j] || ' ' || w[j + 1] AS pair FROM (SELECT *, unnest(range(1, size)) AS j FROM worded_templates)),
worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
pairs AS (SELECT doc_id, i - 1 AS i, w[i] || ' ' || w[i + 1] AS pair FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM worded)),
hits AS (SELECT doc_id, template, label, size, i, j, i - j AS diagonal FROM pairs JOIN pos USING (pair)),
base AS (
  SELECT doc_id, label, min(i) AS lo, 1.0::DOUBLE AS share, true AS base FROM hits WHERE template < 3
  GROUP BY doc_id, template, label, size, diagonal HAVING count(DISTINCT j) = size - 1),
diagonals AS (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS run FROM (
    SELECT doc_id, template, diagonal, CASE WHEN coalesce(diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal), 99) > 2 THEN 1 ELSE 0 END AS fresh
    FROM (SELECT DISTINCT doc_id, template, diagonal FROM hits WHERE template >= 3))),
spans AS (
  SELECT doc_id, template, label, size, run, min(i * 1000 + j) AS lo, max(i * 1000 + j) AS hi,
         len(list_distinct(list_concat(list(j), list(j + 1)))) AS matched
  FROM hits JOIN diagonals USING (doc_id, template, diagonal) GROUP BY ALL),
placed AS (
  SELECT *, lo // 1000 - lo % 1000 AS s, hi // 1000 + size - 1 - hi % 1000 AS e FROM spans),
near AS (
  SELECT p.*, 1 - (greatest(size, e - s + 1) - matched) / size AS share, told,
         CASE WHEN coalesce(list_min(tj), 99) < lo % 1000 THEN s ELSE lo // 1000 END AS a,
         CASE WHEN coalesce(list_max(tj), -1) > hi % 1000 + 1 THEN e ELSE hi // 1000 + 1 END AS b
  FROM placed p JOIN shape USING (template) WHERE 10 * (greatest(size, e - s + 1) - matched) <= 3 * size),
verified AS (
  SELECT n.* FROM near n JOIN worded d USING (doc_id)
  WHERE array_to_string(list_filter(d.w[greatest(a, 0) + 1:b + 1], lambda x: {_TELLS}), ' ') = told),
good AS (
  SELECT doc_id, label, lo // 1000 AS lo, share, false AS base FROM verified v WHERE NOT EXISTS (
    SELECT 1 FROM verified o WHERE o.doc_id = v.doc_id AND o.s <= v.e AND o.e >= v.s
    AND (o.share > v.share OR (o.share = v.share AND (o.size > v.size OR (o.size = v.size AND o.template < v.template)))))
  UNION ALL SELECT * FROM base)
SELECT w.doc_id, len(any_value(w.w))::BIGINT AS n_words, count(lo) FILTER (base)::BIGINT AS n_base, (min(lo) FILTER (base))::BIGINT AS first_word,
       (max(lo) FILTER (base))::BIGINT AS last_word, coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (base))), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (label IS NOT NULL))), ','), '') AS labels, coalesce(max(share), 0.0) AS score
FROM worded w LEFT JOIN good g ON w.doc_id = g.doc_id GROUP BY w.doc_id
"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

LEXICAL = rf"""
WITH worded AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS words FROM documents),
asked AS (SELECT i, any_value(item_id) AS item_id, term, count(*) AS times
          FROM (SELECT row_number() OVER () AS i, item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY i, term),
corpus AS (SELECT count(*) FILTER (len(words) > 0)::BIGINT AS n_docs, sum(len(words))::BIGINT AS n_words FROM worded),
posted AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(words) AS term FROM worded)
           WHERE term IN (SELECT term FROM asked) GROUP BY r, term),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
            FROM posted, corpus GROUP BY term),
scored AS (
  SELECT i, any_value(item_id) AS item_id, r, any_value(doc_id) AS doc_id,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * len(words) * n_docs) // n_words))))::BIGINT AS score
  FROM asked JOIN posted USING (term) JOIN weights USING (term) JOIN worded USING (r), corpus GROUP BY i, r),
ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def _least(*moves: str) -> str:
    """The cheapest of (cost, edits) structs, of equal costs the least edits."""
    return f"list_min([{', '.join(moves)}])"


def _move(place: str, cost: str, edits: str, allowed: str = "true") -> str:
    return f"CASE WHEN {place} IS NOT NULL AND {allowed} THEN {{'c': {place}.c + {cost}, 'a': {place}.a || '{edits}'}} END"


_EDIT = "STRUCT(c BIGINT, a VARCHAR)"

CONVERSATIONS = rf"""
WITH RECURSIVE crcs AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS crc),
marked AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT),
                         lambda x, b: xor(crc[(xor(x, b) & 255) + 1], x >> 8), 4294967295), 4294967295) % 20 AS d
  FROM conversations, crcs),
hurt AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
         CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN d = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM marked WHERE d <> 0),
placed AS (
  SELECT conv_id, turn, role, text, left(role, 1) AS initial,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
         right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS ending FROM hurt),
counted_again AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) AS again FROM placed),
judged AS (
  SELECT *, CASE WHEN ending = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY k) || initial AS pair FROM counted_again),
costed AS (SELECT *, fault IN ('blank', 'duplicate') AS must, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS late FROM judged),
steps AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS k, {{'c': 0::BIGINT, 'a': ''}}::{_EDIT} AS p0, NULL::{_EDIT} AS p1, NULL::{_EDIT} AS p2, NULL::{_EDIT} AS p3 FROM conversations
  UNION ALL
  SELECT conv_id, k, {_move("p0", "2", "D")},
         {_least(_move("p1", "2", "D"), _move("p0", "late", "K", "NOT must AND initial = 's'"))},
         {_least(_move("e2", "2", "D"), *(_move(p, *m) for p in ("p0", "p1", "e3") for m in (("late", "K", "NOT must AND initial = 'u'"), ("late + 1", "R", "NOT must"))))},
         {_least(_move("e3", "2", "D"), _move("e2", "late", "K", "NOT must AND initial = 'a'"), _move("e2", "late + 1", "R", "NOT must"))}
  FROM (SELECT s.conv_id, r.k, p0, p1, {_least("p2", _move("p0", "5", "I"), _move("p1", "5", "I"), _move("p3", "5", "I"))} AS e2,
               {_least("p3", _move("p2", "5", "I"), _move("p0", "10", "II"), _move("p1", "10", "II"))} AS e3, initial, must, late
        FROM steps s JOIN costed r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.k = s.k + 1)),
ended AS (
  SELECT conv_id, {_least("p0", "p3", _move("p2", "5", "I"), _move("p1", "10", "II"))} AS best
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) AS back FROM steps) WHERE back = 1),
edits AS (
  SELECT conv_id, j, e, count(*) FILTER (e <> 'I') OVER w AS k, count(*) FILTER (e <> 'D') OVER w AS o
  FROM (SELECT conv_id, unnest(range(1, length(best.a) + 1)) AS j, best.a[j] AS e FROM ended) WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
kept AS (
  SELECT e.conv_id, j, e, o, role, text, bool_or(o = 1 AND e = 'K' AND initial = 's') OVER (PARTITION BY e.conv_id) AS opened
  FROM edits e LEFT JOIN costed r ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.k = e.k AND e.e <> 'I' WHERE e <> 'D'),
mended AS (
  SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (o - opened::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY j) AS text
  FROM kept GROUP BY conv_id),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM costed GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, best.c AS cost, best.a AS audit,
       sha256(coalesce(m.text, '')) AS repaired_sha256
FROM ended e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN mended m ON m.conv_id IS NOT DISTINCT FROM e.conv_id
"""
