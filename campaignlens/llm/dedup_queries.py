"""Queries of the duplicate operators, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from campaignlens.llm.lines import dedup_lines
from campaignlens.llm.owners import exact_groups
from campaignlens.llm.registry import query
from campaignlens.llm.simhash import near_groups
from campaignlens.sources.readers import read_table


@query(
    "op9_line_dedup",
    r"""
WITH split_up AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
exploded AS (
  SELECT doc_id, unnest(range(len(lines))) AS pos, unnest(lines) AS line FROM split_up),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
  FROM exploded),
frequent AS (
  SELECT line_key, max(doc_id) AS owner FROM keyed WHERE length(line_key) >= 40
  GROUP BY line_key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.*, f.line_key IS NOT NULL AND k.doc_id <> f.owner AS gone
  FROM keyed k LEFT JOIN frequent f ON k.line_key = f.line_key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
)
def op9_line_dedup(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, min_chars=40, min_docs=5).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


@query("op10_simhash_near_dedup")
def op10_simhash_near_dedup(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_groups(docs, words=3, max_bits=2).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query(
    "op8_exact_dedup",
    r"""
WITH bare AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
ranked AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         row_number() OVER w AS nth
  FROM bare WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id))
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, nth = 1 AS kept, text_sha256 FROM ranked
""",
)
def op8_exact_dedup(spark, sf_dir):
    return exact_groups(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
