"""DuckDB SQL of the quality rules."""

from __future__ import annotations

from .quality_rules import CHAR_LIMIT, COMMON_WORDS, MIN_CHARS, MIN_SHARE, MIN_WORDS, WORD_LIMIT

BLANK = r"[\x20\x09-\x0D]"
WORDLIKE = r"[^\x20\x09-\x0D]"


def quality_rules_sql() -> str:
    words = ", ".join(f"'{w}'" for w in COMMON_WORDS)
    count = lambda pattern: f"length(t) - length(regexp_replace(t, '{pattern}', '', 'g'))"
    return f"""
WITH texts AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
split AS (
  SELECT doc_id, lang, t, list_filter(regexp_split_to_array(t, '{BLANK}+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORDLIKE}')) AS ls
  FROM texts
),
counted AS (
  SELECT doc_id, lang, ws, len(ws) AS n_words, {count(WORDLIKE)} AS word_chars, {count("[#*$%&|<>]")} AS n_symbols,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, {count(r"\p{Ll}")} AS lower_, {count(r"\p{Lu}")} AS upper_,
    {count(r"\p{Nd}")} AS digit_, {count(BLANK)} AS blank_
  FROM split
),
word AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM counted),
window_ AS (
  SELECT doc_id, i, w, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY i)
),
again AS (
  SELECT doc_id, i, w2 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, w, w1, w2) > 1 AS again FROM window_
),
covered AS (
  SELECT doc_id, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c FROM again
),
repeats AS (SELECT doc_id, count_if(c) AS n_repeat_words FROM covered GROUP BY doc_id),
base AS (
  SELECT c.*, coalesce(n_repeat_words, 0) AS n_repeat_words,
    n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed
  FROM counted c LEFT JOIN repeats USING (doc_id)
),
common AS (
  SELECT doc_id, lower(w) AS bin, count(*) AS n FROM word WHERE length(w) <= 4 AND lower(w) IN ({words}) GROUP BY ALL
),
bins AS (SELECT unnest([{words}]) AS bin),
hist AS (
  SELECT doc_id, 'chars' AS kind, unnest(['lower', 'upper', 'digit', 'blank', 'symbol', 'other']) AS bin,
    unnest([lower_, upper_, digit_, blank_, n_symbols, word_chars - lower_ - upper_ - digit_ - n_symbols]) AS n
  FROM base
  UNION ALL
  SELECT doc_id, 'words', bin, coalesce(n, 0) FROM base CROSS JOIN bins LEFT JOIN common USING (doc_id, bin)
  UNION ALL
  SELECT doc_id, 'words', '', n_words - coalesce((SELECT sum(n) FROM common c WHERE c.doc_id = base.doc_id), 0) FROM base
),
size AS (SELECT doc_id, kind, greatest(sum(n), 1) AS total FROM hist GROUP BY ALL),
good AS (SELECT doc_id, lang FROM base WHERE lang IS NOT NULL AND NOT base_failed),
langs AS (
  SELECT lang FROM good GROUP BY lang HAVING count(*) >= {MIN_SHARE} * (SELECT count(*) FROM good)
),
sums AS (SELECT lang, kind, bin, sum(n) AS n FROM hist JOIN good USING (doc_id) JOIN langs USING (lang) GROUP BY ALL),
refs AS (SELECT lang, kind, bin, n::DOUBLE / sum(n) OVER (PARTITION BY lang, kind) AS q FROM sums),
shares AS (SELECT doc_id, kind, bin, n::DOUBLE / total AS p FROM hist JOIN size USING (doc_id, kind)),
js AS (
  SELECT doc_id, lang, kind, sqrt(greatest(sum(
    (CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2
  ), 0)) AS distance
  FROM shares JOIN refs USING (kind, bin) GROUP BY ALL
),
near AS (
  SELECT doc_id, round(min(distance) FILTER (kind = 'chars'), 4) AS char_distance,
    round(min(distance) FILTER (kind = 'words'), 4) AS word_distance
  FROM js GROUP BY doc_id
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (
    (word_chars + blank_ >= {MIN_CHARS} AND coalesce(char_distance, 0) > {CHAR_LIMIT})
    OR (n_words >= {MIN_WORDS} AND coalesce(word_distance, 0) > {WORD_LIMIT})
  ) AS kept,
  coalesce(char_distance, 0.0) AS char_distance, coalesce(word_distance, 0.0) AS word_distance
FROM base LEFT JOIN near USING (doc_id)
"""
