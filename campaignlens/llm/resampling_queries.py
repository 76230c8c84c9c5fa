"""The query of the importance resampling operator, beside its SQL."""

from __future__ import annotations

from campaignlens.llm.registry import query
from campaignlens.llm.resampling import resample
from campaignlens.sources.readers import read_table

BUCKETS, MIN_WORDS, PERCENT, SEED = 10_000, 20, 5, 42

# crc32 is linear in its bytes: the checksum of a feature is the xor of what each byte adds
# at its distance from the end (``far``) and of what the start value adds at that length.
ORACLE = rf"""
WITH RECURSIVE step(b, i, v) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL
  SELECT b, i + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM step WHERE i < 8),
one AS (SELECT b, v FROM step WHERE i = 8),
texts AS (
  SELECT 'd' AS side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 't', NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
runs AS (
  SELECT side, doc_id, unnest(list_concat(w, list_concat(
           list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
           list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))) AS feature
  FROM texts),
held AS (SELECT side, doc_id, feature, count(*) AS n FROM runs GROUP BY ALL),
distinct_features AS (SELECT feature, hex(encode(feature)) AS h, octet_length(encode(feature)) AS size FROM (SELECT DISTINCT feature FROM held)),
far(k, b, v) AS (
  SELECT 0::BIGINT, b, v FROM one
  UNION ALL
  SELECT k + 1, far.b, xor(far.v >> 8, one.v) FROM far JOIN one ON one.b = far.v % 256
  WHERE k < (SELECT max(size) FROM distinct_features)),
begin(k, v) AS (
  SELECT 0::BIGINT, 4294967295::BIGINT
  UNION ALL
  SELECT k + 1, xor(begin.v >> 8, one.v) FROM begin JOIN one ON one.b = begin.v % 256
  WHERE k < (SELECT max(size) FROM distinct_features)),
bytes AS (
  SELECT feature, size, unnest(range(size)) AS i, h FROM distinct_features),
summed AS (
  SELECT feature, any_value(size) AS size, bit_xor(far.v) AS v
  FROM bytes JOIN far ON far.k = size - 1 - i AND far.b = CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)
  GROUP BY feature),
bucketed AS (
  SELECT feature, xor(xor(summed.v, begin.v), 4294967295) % {BUCKETS} AS bucket FROM summed JOIN begin ON begin.k = size),
placed AS (SELECT side, doc_id, n, bucket FROM held JOIN bucketed USING (feature)),
counted AS (
  SELECT range AS bucket, coalesce(sum(n) FILTER (side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 't'), 0)::DOUBLE AS t
  FROM range({BUCKETS}) LEFT JOIN placed ON placed.bucket = range GROUP BY range),
gain AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + {BUCKETS}) / ((s + 1) * (sum(t) OVER () + {BUCKETS}))))::BIGINT AS g FROM counted),
weighed AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * g)::BIGINT AS weight FROM placed JOIN gain USING (bucket) WHERE side = 'd' GROUP BY doc_id),
scored AS (
  SELECT x.doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || x.doc_id), 1, 8) AS BIGINT) + 0.5) / 4294967296)))::BIGINT AS score
  FROM texts x LEFT JOIN weighed ON weighed.doc_id = x.doc_id WHERE side = 'd'),
drawn AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS total FROM scored WHERE n_words >= {MIN_WORDS})
SELECT scored.doc_id, n_features, weight, score, CASE WHEN rank <= total * {PERCENT} // 100 THEN rank END AS rank
FROM scored LEFT JOIN drawn ON drawn.doc_id = scored.doc_id
"""


@query("op12_importance_resampling", ORACLE)
def op12_importance_resampling(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    target = read_table(spark, sf_dir, "benchmark")
    found = resample(docs, target, percent=PERCENT, min_words=MIN_WORDS, buckets=BUCKETS, seed=SEED)
    return found.select("doc_id", "n_features", "weight", "score", "rank")
