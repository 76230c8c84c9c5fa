"""Queries of the quality and language operators, beside their SQL."""

from __future__ import annotations

from campaignlens.llm.registry import query
from campaignlens.llm.rules import RULES, judge
from campaignlens.sources.readers import read_table

RISK, ERROR = 0.05, 0.05
_OPTIONS = ", ".join(f"('{r}', {c})" for r, (_, _, options) in RULES.items() for c in options)
_CASES = " ".join(f"WHEN '{r}' THEN 1000 * {count} > c * {base}" for r, (count, base, _) in RULES.items())


@query(
    "op7_quality_rules",
    rf"""
WITH words AS (
  SELECT doc_id, lang, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
windows AS (
  SELECT doc_id, p, list_slice(w, p, p + 7) AS g FROM (
    SELECT doc_id, w, unnest(range(1, greatest(len(w) - 6, 1))) AS p FROM words)),
twice AS (
  SELECT doc_id, p FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p + o) AS n FROM twice, (SELECT unnest(range(0, 8)) AS o) GROUP BY doc_id),
lines AS (
  SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM words),
counts AS (
  SELECT words.doc_id, lang, CAST(len(w) AS BIGINT) AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
         (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_upper, CAST(len(l) AS BIGINT) AS n_lines
  FROM words JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
based AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts),
options(rule, c) AS (VALUES {_OPTIONS}),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1),
holdout AS (
  SELECT lang, rule, c, count(*) AS n, count(*) FILTER (CASE rule {_CASES} END) AS x
  FROM based JOIN good USING (doc_id), options WHERE NOT base_failed GROUP BY lang, rule, c),
tested AS (
  SELECT lang, rule, c, list_sum(list_transform(range(0, x + 1), lambda i:
           exp(lgamma(n + 1) - CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1) END - CASE WHEN i = n THEN 0 ELSE lgamma(n - i + 1) END
               + i * ln({RISK / len(RULES)!r}) + (n - i) * ln(1 - {RISK / len(RULES)!r})))) AS tail
  FROM holdout),
limits AS (
  SELECT lang, rule, min(c) AS c FROM tested
  WHERE tail <= {ERROR!r} / (SELECT count(*) FROM holdout) GROUP BY lang, rule),
broken AS (
  SELECT DISTINCT doc_id FROM based JOIN limits ON based.lang IS NOT DISTINCT FROM limits.lang WHERE CASE rule {_CASES} END)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM broken) AS kept
FROM based
""",
)
def op7_quality_rules(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return judge(docs, read_table(spark, sf_dir, "labels"), RISK, ERROR).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
