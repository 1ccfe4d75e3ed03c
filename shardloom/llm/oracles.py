"""SQL for one database, for the operators whose whole result it can express.

The others (compressed sizes, tokenizer ids, XXH64 fingerprints, matches' places, random walks,
trained models, packings that are one of many) are tested against brute force instead.
"""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Words that no window of 35 occurring twice covers.
REPEATS = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT r, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
k AS (SELECT p.r, p.i, array_to_string(list_slice(d.w, p.i, p.i + 34), ' ') AS s FROM p JOIN d ON d.r = p.r),
c AS (SELECT s FROM k GROUP BY s HAVING count(*) > 1),
e AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM k JOIN c ON c.s = k.s),
x AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
g AS (SELECT x.r, count(e.j) AS n_removed, string_agg(x.word, ' ' ORDER BY x.j) FILTER (WHERE e.j IS NULL) AS kept FROM x LEFT JOIN e ON e.r = x.r AND e.j = x.j GROUP BY x.r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(g.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(g.kept, '')) AS kept_sha256
FROM d LEFT JOIN g ON g.r = d.r
"""

#: Counts, the base rule, and fences about quartiles of logarithmic buckets, drawn towards the language's and all texts'.
RULES = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
p AS (SELECT r, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5),
k AS (SELECT p.r, p.i, list_slice(d.w, p.i, p.i + 4) AS s FROM p JOIN d ON d.r = p.r),
o AS (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM k),
e AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS j FROM o WHERE n > 1) GROUP BY r),
l AS (SELECT r, count(*) AS n, count(DISTINCT line) AS k FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
c AS (
  SELECT d.r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(l.n - l.k, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(e.n, 0) AS BIGINT) AS n_repeat_words, coalesce(l.n, 0) AS n_lines
  FROM d LEFT JOIN e ON e.r = d.r LEFT JOIN l ON l.r = d.r
),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c),
v AS (
  SELECT r, lang, source, base_failed, unnest(['symbol_rate', 'mean_word', 'dup_line_rate', 'repeat_rate', 'word_chars', 'n_lines', 'n_words']) AS rate,
    unnest([coalesce(n_symbols::DOUBLE / nullif(word_chars, 0), 0), coalesce(word_chars::DOUBLE / nullif(n_words, 0), 0), coalesce(n_dup_lines::DOUBLE / nullif(n_lines, 0), 0), coalesce(n_repeat_words::DOUBLE / nullif(n_words, 0), 0),
      word_chars::DOUBLE, n_lines::DOUBLE, n_words::DOUBLE]) AS x
  FROM f
),
b AS (SELECT lang, source, rate, CASE WHEN x > 0 THEN CAST(ceil(ln(x) / ln(1.015::DOUBLE)) AS INT) END AS bucket FROM v WHERE NOT base_failed),
u AS (
  SELECT 's' AS level, lang, source, rate, bucket, count(*) AS n FROM b GROUP BY ALL
  UNION ALL SELECT 'l', lang, '', rate, bucket, count(*) FROM b GROUP BY ALL
  UNION ALL SELECT 'w', '', '', rate, bucket, count(*) FROM b GROUP BY ALL
),
a AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rate ORDER BY bucket NULLS FIRST) AS upto, sum(n) OVER (PARTITION BY level, lang, source, rate) AS total,
  CASE WHEN bucket IS NULL THEN 0 ELSE pow(1.015::DOUBLE, bucket) * (2 / 2.015::DOUBLE) END AS middle FROM u),
q AS (SELECT level, lang, source, rate, min(middle) FILTER (WHERE upto >= 0.25 * total) AS q1, min(middle) FILTER (WHERE upto >= 0.5 * total) AS q2, min(middle) FILTER (WHERE upto >= 0.75 * total) AS q3, max(total) AS n FROM a GROUP BY ALL),
h AS (
  SELECT s.lang, s.source, s.rate,
    (s.n * s.q1 + 100 * ((l.n * l.q1 + 100 * w.q1) / (l.n + 100))) / (s.n + 100) AS q1, (s.n * s.q2 + 100 * ((l.n * l.q2 + 100 * w.q2) / (l.n + 100))) / (s.n + 100) AS q2,
    (s.n * s.q3 + 100 * ((l.n * l.q3 + 100 * w.q3) / (l.n + 100))) / (s.n + 100) AS q3
  FROM q s JOIN q l ON l.level = 'l' AND l.lang = s.lang AND l.rate = s.rate JOIN q w ON w.level = 'w' AND w.rate = s.rate WHERE s.level = 's'
),
t AS (
  SELECT h.lang, h.source, h.rate, h.q3 + greatest(3 * (h.q3 - h.q1), CASE h.rate WHEN 'symbol_rate' THEN 3 / greatest(z.q2, 1) WHEN 'dup_line_rate' THEN 3 / greatest(z.q2, 1) WHEN 'repeat_rate' THEN 30 / greatest(z.q2, 1) ELSE 0.03 * h.q3 END) AS high,
    CASE h.rate WHEN 'mean_word' THEN h.q1 - greatest(3 * (h.q3 - h.q1), 0.03 * h.q3) END AS low
  FROM h LEFT JOIN h z ON z.lang = h.lang AND z.source = h.source AND z.rate = CASE h.rate WHEN 'symbol_rate' THEN 'word_chars' WHEN 'dup_line_rate' THEN 'n_lines' WHEN 'repeat_rate' THEN 'n_words' END
  WHERE h.rate IN ('symbol_rate', 'mean_word', 'dup_line_rate', 'repeat_rate')
),
j AS (SELECT v.r, bool_and(coalesce(v.x <= t.high, true) AND coalesce(v.x >= t.low, true)) AS inside FROM v LEFT JOIN t ON t.lang = v.lang AND t.source = v.source AND t.rate = v.rate GROUP BY v.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND inside AS kept FROM f JOIN j ON j.r = f.r
"""
