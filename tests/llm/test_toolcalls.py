"""Tool-call linking: schema checks, canonical JSON, topological order by brute force, edge cases, SQL."""

from __future__ import annotations

import glob
import json
import os
import random

import duckdb
import pytest

from campaignlens.llm import chat_queries
from campaignlens.llm.arguments import canonical, faults, parsed
from campaignlens.llm.registry import ORACLES
from campaignlens.llm.toolcalls import link_calls, waves

CALLS = "conv_id long, call_id string, turn long, name string, arguments string, after array<string>, status string"
RESULTS = "conv_id long, call_id string, content string, wave int"
SCHEMAS = {"f": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}}}}


@pytest.mark.parametrize(
    "value,text",
    [
        ({"b": 1, "a": [1.0, 2.5, True, None]}, '{"a":[1,2.5,true,null],"b":1}'),
        ({"\U0001f600": 1, "￮": 2}, '{"\U0001f600":1,"￮":2}'),
        ('a"\\\n\x01é/', '"a\\"\\\\\\n\\u0001é/"'),
    ],
)
def test_canonical(value, text):
    assert canonical(value) == text and json.loads(text) == value


@pytest.mark.parametrize("text", ["", "{", '{"a":1,"a":2}', "NaN", "[Infinity]"])
def test_strict_parsing(text):
    with pytest.raises(ValueError):
        parsed(text)


@pytest.mark.parametrize(
    "value,schema,found",
    [
        (1.0, {"type": "integer"}, []),
        (True, {"type": "number"}, ["$: type"]),
        ({"a": "x", "z": 1}, {"properties": {"a": {"type": "integer"}}, "additionalProperties": False, "required": ["b"]}, ["$.a: type", "$.b: required", "$.z: unknown"]),
        ([1, "x"], {"items": {"type": ["integer", "null"]}}, ["$[1]: type"]),
        (7, {"minimum": 8, "maximum": 6, "enum": [1]}, ["$: enum", "$: maximum", "$: minimum"]),
        ("abc", {"minLength": 4, "maxLength": 2}, ["$: maxLength", "$: minLength"]),
        (None, {"type": "null"}, []),
    ],
)
def test_faults(value, schema, found):
    assert faults(value, schema) == found


def order_by_hand(turns, deps):
    """Longest keys by relaxation; calls on or behind a cycle have none."""
    key = {c: (t, 0) for c, t in turns.items()}
    blocked = set()

    def ancestors(c, seen):
        for d in deps.get(c, ()):
            if d not in seen:
                seen.add(d)
                ancestors(d, seen)
        return seen

    for c in turns:
        up = ancestors(c, set())
        if c in up or any(u in ancestors(u, set()) for u in up):
            blocked.add(c)
    for _ in turns:
        for c in turns:
            if c not in blocked:
                key[c] = max([key[c], *((key[d][0], key[d][1] + 1) for d in deps.get(c, ()))])
    return {c: (None, None) if c in blocked else key[c] for c in turns}


def test_order_by_hand(spark):
    rng = random.Random(9)
    nodes, edges, expected = [], [], {}
    for conv in range(25):
        turns = {f"c{i}": rng.randrange(6) for i in range(rng.randint(1, 9))}
        deps = {c: {rng.choice(list(turns)) for _ in range(rng.choice([0, 0, 1, 2]))} for c in turns}
        nodes += [(conv, c, t) for c, t in turns.items()]
        edges += [(conv, c, d) for c, ds in deps.items() for d in ds]
        expected |= {(conv, c): k for c, k in order_by_hand(turns, deps).items()}
    found = waves(spark.createDataFrame(nodes, "conv_id long, call_id string, turn long"), spark.createDataFrame(edges, "conv_id long, call_id string, dep string"))
    found = {(r.conv_id, r.call_id): (r.wave, r.hop) for r in found.collect()}
    assert found == expected and any(k[0] is None for k in found.values()) and any((k[1] or 0) > 1 for k in found.values())
    assert all(found[c, d] < found[c, a] for c, a, d in edges if found[c, a][0] is not None)


def test_edge_cases(spark):
    calls = [
        (1, "a", 1, "f", '{"a": 1.0}', [], "x"),
        (1, "b", None, "f", None, ["a", "zz", None], "x"),
        (1, "c", 3, "f", '{"a":', None, "x"),
        (1, "d", 3, None, '{"a":1}', None, "x"),
        (1, "e", 4, "f", '{"a":1}', ["e"], "x"),
        (2, "a", 1, "f", '{"a":1}', ["b"], "x"),
        (2, "a", 1, "f", '{"a":1}', ["b"], "x"),
        (2, "b", 9, "f", '{"a":1, "long": "' + "y" * 200_000 + '"}', [], "x"),
        (None, "a", 1, "f", '{"a":1}', [], "x"),
        (3, None, 1, "f", '{"a":1}', ["a"], "x"),
    ]
    results = [(1, "a", "r2", 1), (1, "a", "r1", 1), (1, "b", None, 1), (2, "b", "", 1), (5, "q", "lost", 1), (None, "a", None, 1), (None, None, None, None)]
    df = link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS)
    rows = ((r.conv_id or 0, r.call_id or "", r.status, r.n_results, r.wave, r.hop, r.n_missing, r.valid) for r in df.collect())
    assert sorted(rows, key=repr) == sorted(
        [
            (1, "a", "ok", 2, 1, 0, 0, True),
            (1, "a", "extra_result", 1, None, None, 0, None),
            (1, "b", "invalid", 1, 1, 1, 1, False),
            (1, "c", "invalid", 0, 3, 0, 0, False),
            (1, "d", "invalid", 0, 3, 0, 0, False),
            (1, "e", "cycle", 0, None, None, 0, True),
            (2, "a", "duplicate_id", 0, 9, 1, 0, True),
            (2, "a", "duplicate_id", 0, 9, 1, 0, True),
            (2, "b", "ok", 1, 9, 0, 0, True),
            (0, "a", "no_id", 0, None, None, 0, True),
            (3, "", "no_id", 0, None, None, 0, True),
            (5, "q", "orphan_result", 1, None, None, 0, None),
            (0, "a", "orphan_result", 1, None, None, 0, None),
            (0, "", "orphan_result", 1, None, None, 0, None),
        ],
        key=repr,
    )
    messages = {(r.conv_id, r.call_id): r.message for r in df.where("status <> 'extra_result'").collect()}
    assert messages[1, "a"] == '{"arguments":{"a":1},"id":"a","name":"f","result":"r1"}'
    assert messages[1, "c"] == '{"arguments":"{\\"a\\":","id":"c","name":"f","result":null}'
    empty = link_calls(spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS), SCHEMAS)
    assert empty.count() == 0


def test_query_agrees_with_sql(spark):
    directory, db = "/root/testdata/sf0.001", duckdb.connect()
    for path in glob.glob(f"{directory}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    df, sql = chat_queries.op3_tool_calls(spark, directory), db.sql(ORACLES["op3_tool_calls"])
    names = sorted(df.columns)
    assert names == sorted(sql.columns)
    assert sorted(repr(tuple(r[c] for c in names)) for r in df.collect()) == sorted(map(repr, sql.select(*names).fetchall()))


def test_every_result_has_a_row(spark):
    rng = random.Random(3)
    results = [(c, f"c{rng.randrange(4)}", rng.choice(["x", "y", None, "long " * 20_000]), 1) for c in range(4) for _ in range(25)]
    calls = [(c, f"c{i}", i, "f", '{"a":1}', [], "x") for c in range(4) for i in range(c)]
    found = link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS).collect()
    contents = sorted((r.conv_id, r.call_id, repr(json.loads(r.message)["result"])) for r in found if r.n_results)
    assert contents == sorted((c, i, repr(t)) for c, i, t, _ in results)
    for r in found:
        known = (r.conv_id, r.call_id) in {(c[0], c[1]) for c in calls}
        assert r.status in (("ok", "extra_result", "no_result") if known else ("orphan_result",))
    assert sum(r.status in ("ok", "no_result") for r in found) == len(calls)


@pytest.mark.parametrize(
    "schema",
    [{"pattern": "a"}, {"properties": {"a": {"anyOf": []}}}, {"items": {"$ref": "#"}}, {"additionalProperties": {"type": "string"}}, {"type": "date"}, True],
)
def test_schemas_that_are_not_understood_are_refused(spark, schema):
    with pytest.raises(ValueError):
        link_calls(spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS), {"f": schema})
