"""Query op8_quality_rules and its SQL."""

from .common import read
from .quality_rules import quality_verdicts


def op8_quality_rules(spark, sf_dir):
    return quality_verdicts(read(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
b AS (
  SELECT *, len(words) AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM w),
g AS (SELECT r, unnest(range(1, n_words - 1)) AS i, words FROM b WHERE n_words >= 3),
k AS (SELECT r, i, count(*) OVER (PARTITION BY r, words[i], words[i + 1], words[i + 2]) AS times FROM g),
p AS (SELECT r, count(DISTINCT i + o) AS n_repeat_words FROM k, (SELECT unnest([0, 1, 2]) AS o) WHERE times >= 2 GROUP BY r),
m AS (
  SELECT b.*, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM b LEFT JOIN p USING (r))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > word_chars
    OR (n_dup_lines >= 5 AND 2 * n_dup_lines > len(string_split(t, chr(10))))
    OR word_chars > 25 * n_words OR word_chars < 2 * n_words
    OR 2 * length(regexp_replace(t, '[^\p{L}]', '', 'g')) < word_chars
    OR 50 * len(list_distinct(words)) < least(n_words, 2000)
    OR 2 * (SELECT max(n) FROM (SELECT count(*) AS n FROM (SELECT unnest(words) AS x) GROUP BY x)) > n_words
    OR (len(string_split(t, chr(10))) >= 10 AND 10 * len(list_filter(string_split(t, chr(10)), lambda x: ends_with(rtrim(x), '...') OR ends_with(rtrim(x), '…'))) > 9 * len(string_split(t, chr(10))))) AS kept
FROM m
"""
