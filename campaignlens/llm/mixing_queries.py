"""The query of the mixing operator, beside its SQL."""

from __future__ import annotations

from campaignlens.llm.mixing import mix_sources
from campaignlens.llm.registry import query
from campaignlens.sources.readers import read_table

# Target weights in percent: one large crawl source, smaller ones raised by quality; the
# pool of all other sources has 4.
TARGET_WEIGHTS = {"src0": 20} | {f"src{k}": (8, 6, 4, 2)[k % 4] if k < 13 else 3 for k in range(1, 19)}
REST_WEIGHT, BLOCK_DOCS, SEED = 4, 16, 7

_VALUES = ", ".join(f"({i}, '{s}', {w})" for i, (s, w) in enumerate(TARGET_WEIGHTS.items()))
_REST = len(TARGET_WEIGHTS)

# Block by block, the schedule by its definition.
ORACLE = f"""
WITH RECURSIVE target(no, source, w) AS (VALUES {_VALUES}),
ranked AS (
  SELECT doc_id, d.source, coalesce(t.no, {_REST}) AS no,
         row_number() OVER (PARTITION BY coalesce(t.no, {_REST}) ORDER BY md5('{SEED}:' || doc_id), doc_id) - 1 AS r
  FROM documents d LEFT JOIN target t ON d.source = t.source),
supply AS (
  SELECT list(w ORDER BY s.no) AS w, list(coalesce(n, 0) ORDER BY s.no) AS n
  FROM (SELECT no, w FROM target UNION ALL SELECT {_REST}, {REST_WEIGHT}) s
  LEFT JOIN (SELECT no, CAST(ceil(count(*) / {BLOCK_DOCS}) AS BIGINT) AS n FROM ranked GROUP BY no) c ON c.no = s.no),
state AS (
  SELECT CAST(-1 AS BIGINT) AS slot, CAST(0 AS BIGINT) AS start, 0 AS phase, list_transform(w, lambda x: CAST(0 AS BIGINT)) AS done,
         list_transform(w, lambda x: CAST(0 AS BIGINT)) AS placed, CAST(NULL AS BIGINT) AS pick,
         CAST(0 AS BIGINT) AS block, CAST(0 AS BIGINT) AS release, CAST(0 AS BIGINT) AS deadline, FALSE AS ended FROM supply
  UNION ALL
  SELECT slot, CASE WHEN ended THEN slot + 1 ELSE start END, CASE WHEN ended THEN phase + 1 ELSE phase END,
         list_transform(done, lambda x, i: CASE WHEN ended THEN 0 ELSE x + CASE WHEN i = pick THEN 1 ELSE 0 END END),
         placed, pick, block, release, deadline, ended
  FROM (
    SELECT y.slot, y.phase, y.start, y.done, y.pick, y.block, y.release, y.deadline,
           list_transform(y.placed, lambda x, i: x + CASE WHEN i = y.pick THEN 1 ELSE 0 END) AS placed,
           y.placed[y.pick] + 1 = y.n[y.pick] AS ended
    FROM (
      SELECT x.*, best.i AS pick, x.placed[best.i] AS block,
             x.start + (x.done[best.i] * total) // x.w[best.i] AS release, x.start + best.deadline AS deadline
      FROM (
        SELECT a.*, list_min(list_filter(list_transform(range(1, len(a.w) + 1), lambda i:
            CASE WHEN a.placed[i] < a.n[i] AND (a.done[i] * a.total) // a.w[i] <= a.slot - a.start
                 THEN {{'deadline': ((a.done[i] + 1) * a.total + a.w[i] - 1) // a.w[i], 'i': i}} END), lambda z: z IS NOT NULL)) AS best
        FROM (
          SELECT s.slot + 1 AS slot, s.start, s.phase, s.done, s.placed, u.w, u.n,
                 CAST(list_sum(list_transform(range(1, len(u.w) + 1), lambda i: CASE WHEN s.placed[i] < u.n[i] THEN u.w[i] ELSE 0 END)) AS BIGINT) AS total
          FROM state s, supply u) a
        WHERE a.total > 0) x) y)),
shown AS (
  SELECT pick - 1 AS no, block, release, deadline, slot, CASE WHEN ended THEN phase - 1 ELSE phase END AS phase
  FROM state WHERE pick IS NOT NULL)
SELECT doc_id, source, phase AS mix_phase, s.block AS mix_block, release AS mix_release, deadline AS mix_deadline,
       slot AS mix_slot, r % {BLOCK_DOCS} AS mix_place
FROM ranked JOIN shown s ON s.no = ranked.no AND s.block = r // {BLOCK_DOCS}
"""


@query("op1_source_mixing", ORACLE)
def op1_source_mixing(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix_sources(docs, TARGET_WEIGHTS, REST_WEIGHT, BLOCK_DOCS, SEED)
