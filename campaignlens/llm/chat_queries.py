"""The query of the tool-call operator, beside its SQL.

The conversations hold no tool calls, so a trace is derived from all their turns: every
assistant turn becomes a call with its whole text among the arguments, every user turn the
result of the call before it. Text lengths decide the tool and the faults: unknown tools,
missing and wrong arguments, calls that wait for later ones and for each other.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from campaignlens.llm.registry import query
from campaignlens.llm.toolcalls import link_calls
from campaignlens.sources.readers import read_table

SCHEMAS = {
    "search": {
        "type": "object",
        "required": ["query", "limit"],
        "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 0, "maximum": 50}},
        "additionalProperties": False,
    },
    "translate": {
        "type": "object",
        "required": ["text", "to"],
        "properties": {"text": {"type": "string"}, "to": {"enum": ["de", "en", "fr"]}},
    },
    "count": {"type": "object", "required": ["text"], "properties": {"text": {"type": "string"}}},
}


def trace(turns):
    """(calls, results) of a conversations table."""
    n = F.char_length(F.coalesce("text", F.lit("")))
    ident = lambda t: F.concat(F.lit("c"), t.cast("string"))
    turn = F.col("turn")
    tool = F.when(n % 11 == 0, "ping").when(n % 3 == 0, "search").when(n % 3 == 1, "translate").otherwise("count")
    search = F.struct((n % 60).alias("limit"), F.col("text").alias("query"))
    translate = F.struct(F.col("text"), F.when(n % 4 == 0, "xx").otherwise("fr").alias("to"))
    counting = F.when(n % 5 == 0, F.to_json(F.struct(n.alias("size")))).otherwise(F.to_json(F.struct("text")))
    calls = turns.where("role = 'assistant'").select(
        "conv_id",
        ident(turn).alias("call_id"),
        "turn",
        tool.alias("name"),
        F.when(tool == "search", F.to_json(search)).when(tool == "translate", F.to_json(translate)).otherwise(counting).alias("arguments"),
        F.when(n % 7 == 0, F.array(ident(turn + 2)))
        .when(n % 2 == 0, F.array(ident(turn - 2)))
        .otherwise(F.array().cast("array<string>"))
        .alias("after"),
    )
    results = turns.where("role = 'user'").select("conv_id", ident(turn - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


@query(
    "op3_tool_calls",
    """
WITH RECURSIVE calls AS (
  SELECT conv_id, turn, 'c' || turn AS call_id, text, length(text) AS n,
         CASE WHEN length(text) % 11 = 0 THEN 'ping' WHEN length(text) % 3 = 0 THEN 'search'
              WHEN length(text) % 3 = 1 THEN 'translate' ELSE 'count' END AS name,
         CASE WHEN length(text) % 7 = 0 THEN turn + 2 WHEN length(text) % 2 = 0 THEN turn - 2 END AS dep
  FROM conversations WHERE role = 'assistant'),
walks AS (
  SELECT conv_id, call_id, turn AS place, 0 AS hops, [turn] AS seen, FALSE AS looped FROM calls
  UNION ALL
  SELECT w.conv_id, w.call_id, d.turn, hops + 1, list_append(seen, d.turn), list_contains(seen, d.turn)
  FROM walks w JOIN calls c ON c.conv_id = w.conv_id AND c.turn = w.place
               JOIN calls d ON d.conv_id = w.conv_id AND d.turn = c.dep
  WHERE NOT looped),
keys AS (
  SELECT conv_id, call_id, bool_or(looped) AS looped, max(place) AS wave, max(hops) FILTER (place = top) AS hop
  FROM (SELECT *, max(place) OVER (PARTITION BY conv_id, call_id) AS top FROM walks) GROUP BY conv_id, call_id),
judged AS (
  SELECT c.*, looped, wave, hop,
    CASE name
      WHEN 'ping' THEN ['$: tool']
      WHEN 'search' THEN list_concat(CASE WHEN n % 60 > 50 THEN ['$.limit: maximum'] ELSE CAST([] AS VARCHAR[]) END,
                                     CASE WHEN n = 0 THEN ['$.query: minLength'] ELSE CAST([] AS VARCHAR[]) END)
      WHEN 'translate' THEN CASE WHEN n % 4 = 0 THEN ['$.to: enum'] ELSE CAST([] AS VARCHAR[]) END
      ELSE CASE WHEN n % 5 = 0 THEN ['$.text: required'] ELSE CAST([] AS VARCHAR[]) END END AS errors,
    CASE WHEN name = 'search' THEN '{"limit":' || n % 60 || ',"query":' || to_json(text) || '}'
         WHEN name = 'translate' THEN '{"text":' || to_json(text) || ',"to":"' || CASE WHEN n % 4 = 0 THEN 'xx' ELSE 'fr' END || '"}'
         WHEN n % 5 = 0 THEN '{"size":' || n || '}' ELSE '{"text":' || to_json(text) || '}' END AS arguments,
    CASE WHEN dep IS NOT NULL AND NOT EXISTS (SELECT 1 FROM calls d WHERE d.conv_id = c.conv_id AND d.turn = c.dep) THEN 1 ELSE 0 END AS n_missing
  FROM calls c JOIN keys USING (conv_id, call_id)),
results AS (SELECT conv_id, 'c' || (turn - 1) AS call_id, text AS content FROM conversations WHERE role = 'user')
SELECT conv_id, call_id,
       CASE WHEN looped THEN 'cycle' WHEN len(errors) > 0 THEN 'invalid' WHEN content IS NULL THEN 'no_result' ELSE 'ok' END AS status,
       CAST(CASE WHEN content IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_results,
       CASE WHEN looped THEN NULL ELSE wave END AS wave, CAST(CASE WHEN looped THEN NULL ELSE hop END AS BIGINT) AS hop,
       CAST(n_missing AS BIGINT) AS n_missing, len(errors) = 0 AS valid, errors,
       '{"arguments":' || arguments || ',"id":"' || call_id || '","name":"' || name || '","result":'
         || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || '}' AS message
FROM judged LEFT JOIN results USING (conv_id, call_id)
UNION ALL
SELECT conv_id, call_id, 'orphan_result', 1, NULL, NULL, 0, NULL, CAST([] AS VARCHAR[]),
       '{"id":"' || call_id || '","result":' || to_json(content) || '}'
FROM results ANTI JOIN calls USING (conv_id, call_id)
""",
)
def op3_tool_calls(spark, sf_dir):
    calls, results = trace(read_table(spark, sf_dir, "conversations"))
    return link_calls(calls, results, SCHEMAS)
