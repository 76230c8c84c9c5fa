"""Linking tool calls with their results: join, topological order, validation, canonical JSON."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campaignlens.llm.arguments import canonical, check_schema, faults, parsed
from campaignlens.llm.texts import slices
from campaignlens.session import discard, shared_dir, written

LINKED = (
    "conv_id long, call_id string, status string, n_results long, wave long, hop long, "
    "n_missing long, valid boolean, errors array<string>, message string"
)


# The wave of calls behind a cycle, beyond every turn; it passes on as it is.
BLOCKED = (1 << 63) - 1
NOTHING = -(1 << 63)
CALL = ["conv_id", "call_id"]


def _key(wave: Column | str, hop: Column | str) -> Column:
    wave, hop = (F.col(x) if isinstance(x, str) else x for x in (wave, hop))
    return F.struct(wave.cast("long").alias("wave"), hop.cast("long").alias("hop"))


def _chains(singles: DataFrame) -> DataFrame:
    """Where the chain of calls with one dependency each ends, by doubling.

    ``singles`` has conv_id, call_id, turn, dep and bound (the calls of the conversation).
    The result has the end (the first call with no or with several dependencies), the
    steps to it, the best key on the way (strictly between) and whether there is an end at all.
    """
    none = _key(F.lit(NOTHING), F.lit(0))
    jumps = written(singles.select(*CALL, "turn", "bound", F.col("dep").alias("end"), F.lit(1).cast("long").alias("steps"), none.alias("best"), F.lit(False).alias("ended")), "chains")
    while True:
        ahead = jumps.select(
            "conv_id", F.col("call_id").alias("end"), F.col("turn").alias("a_turn"), F.col("end").alias("a_end"),
            F.col("steps").alias("a_steps"), F.col("best").alias("a_best"),
        )
        open_ = jumps.where("NOT ended AND steps <= bound")
        if open_.isEmpty():
            return jumps.select(*CALL, "turn", "end", "steps", "best", "ended")
        on_the_way = F.greatest("best", _key("a_turn", "steps"), _key("a_best.wave", F.col("a_best.hop") + F.col("steps")))
        moved = open_.join(ahead, ["conv_id", "end"], "left").select(
            *CALL,
            "turn",
            "bound",
            F.coalesce("a_end", "end").alias("end"),
            (F.col("steps") + F.coalesce("a_steps", F.lit(0))).alias("steps"),
            F.when(F.col("a_end").isNull(), F.col("best")).otherwise(on_the_way).alias("best"),
            F.col("a_end").isNull().alias("ended"),
        )
        done, jumps = jumps, written(jumps.where("ended OR steps > bound").unionByName(moved), "chains")
        discard(done)


def _raised(ends: DataFrame, edges: DataFrame) -> DataFrame:
    """Keys (column ``key``) of the calls that end chains, by rounds of raising.

    ``ends`` has conv_id, call_id, turn, bound; ``edges`` conv_id, call_id, end, steps, best. A
    round costs joins over the conversations that still move; there are as many rounds as the
    longest chain of calls with several dependencies. A hop beyond ``bound`` is a cycle.
    """
    spark, held = ends.sparkSession, None
    state = ends.select(*CALL, "bound", _key("turn", F.lit(0)).alias("key"))
    edges = written(edges, "edges")
    settled = shared_dir(spark, "waves")
    while True:
        fronts = state.select("conv_id", F.col("call_id").alias("end"), F.col("key").alias("e_key"))
        passed = F.when(F.col("e_key.wave") < BLOCKED, F.col("e_key.hop") + F.col("steps")).otherwise(0)
        pushed = (
            edges.join(fronts, ["conv_id", "end"])
            .groupBy(*CALL)
            .agg(F.max(F.greatest("best", _key("e_key.wave", passed))).alias("pushed"))
        )
        table = written(
            state.join(pushed, CALL, "left").select(
                *CALL, "bound", F.greatest("key", "pushed").alias("key"), F.coalesce(F.col("pushed") > F.col("key"), F.lit(False)).alias("up")
            ),
            "round",
        )
        moving = table.where("up").select("conv_id").distinct()
        table.join(moving, "conv_id", "left_anti").select(*CALL, "key").write.mode("append").parquet(settled)
        if held is not None:
            discard(held)
        held = table
        if moving.isEmpty():
            return spark.read.parquet(settled)
        looping = F.col("key.hop") > F.col("bound")
        state = table.join(moving, "conv_id", "left_semi").select(
            *CALL, "bound", F.when(looping, _key(F.lit(BLOCKED), F.lit(0))).otherwise(F.col("key")).alias("key")
        )


def waves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A topological order of calls: (conv_id, call_id, wave, hop), both null where a cycle blocks the call.

    ``nodes`` has conv_id, call_id and turn (unique, not null), ``edges`` conv_id, call_id and
    dep, both ends among the nodes. A call's key is the largest (turn, steps) over itself and
    all it depends on, near and far, so that ordering by (wave, hop) puts every call after
    its dependencies. Chains of calls with one dependency each are followed by doubling, in
    as many rounds as the logarithm of the longest conversation; only calls with several
    dependencies are worked chain by chain.
    """
    counted = edges.groupBy(*CALL).agg(F.count("*").alias("n_deps"), F.min("dep").alias("dep"))
    bounds = nodes.groupBy("conv_id").agg(F.count("*").alias("bound"))
    known = written(nodes.join(counted, CALL, "left").join(bounds, "conv_id").withColumn("n_deps", F.coalesce("n_deps", F.lit(0))), "nodes")
    chains = _chains(known.where("n_deps = 1").select(*CALL, "turn", "bound", "dep"))
    ends = known.where("n_deps <> 1")
    # A call with several dependencies looks along each of them to the end of its chain.
    links = edges.join(ends.where("n_deps > 1").select(*CALL), CALL, "left_semi")
    chained = chains.select(
        "conv_id", F.col("call_id").alias("dep"), F.col("turn").alias("c_turn"), "end", F.col("steps").alias("c_steps"), F.col("best").alias("c_best"), "ended"
    )
    along = F.greatest(_key("c_turn", F.lit(1)), _key("c_best.wave", F.col("c_best.hop") + 1))
    far = links.join(chained, ["conv_id", "dep"], "left").select(
        *CALL,
        F.coalesce("end", "dep").alias("end"),
        (F.coalesce("c_steps", F.lit(0)) + 1).alias("steps"),
        F.when(F.col("ended").isNull(), _key(F.lit(NOTHING), F.lit(0)))
        .when(F.col("ended"), along)
        .otherwise(_key(F.lit(BLOCKED), F.lit(0)))
        .alias("best"),
        F.col("ended"),
    )
    # A chain without an end blocks; any call of its own may stand in for the end it lacks.
    far = far.withColumn("end", F.when(F.coalesce("ended", F.lit(True)), F.col("end")).otherwise(F.col("call_id"))).drop("ended")
    settled = _raised(ends.select(*CALL, "turn", "bound"), far)
    last = settled.select("conv_id", F.col("call_id").alias("end"), F.col("key").alias("e_key"))
    passed = F.when(F.col("e_key.wave") < BLOCKED, F.col("e_key.hop") + F.col("steps")).otherwise(0)
    followed = chains.join(last, ["conv_id", "end"], "left").select(
        *CALL,
        F.when(~F.col("ended"), _key(F.lit(BLOCKED), F.lit(0)))
        .otherwise(F.greatest(_key("turn", F.lit(0)), "best", _key("e_key.wave", passed)))
        .alias("key"),
    )
    free = F.col("key.wave") < BLOCKED
    return settled.select(*CALL, "key").union(followed).select(
        *CALL, F.when(free, F.col("key.wave")).alias("wave"), F.when(free, F.col("key.hop")).alias("hop")
    )


def link_calls(calls: DataFrame, results: DataFrame, schemas: Mapping[str, dict]) -> DataFrame:
    """One row per call, and one per result that no call asked for.

    ``calls``: conv_id, call_id, turn, name, arguments (JSON text), after (array of the ids
    it depends on). ``results``: conv_id, call_id, content. Calls and results meet in a join
    on conversation and id. Columns of the result:

    - ``status``: ok, invalid (arguments break the schema, or are no JSON, or the tool is
      unknown), no_result, duplicate_id (several calls have the id), cycle (it waits for
      itself or for such a call), no_id, orphan_result, extra_result. The first that holds in
      the order orphan_result, extra_result, no_id, duplicate_id, cycle, invalid, no_result.
    - ``n_results``: of several results the smallest content goes with the call; every other
      one, equal contents too, is a row of its own with status extra_result (orphan_result
      where no call has the id) that counts itself.
    - ``wave`` and ``hop``: the topological order within the conversation, ties by id; null
      where there is none (cycle, no_id, orphan_result).
    - ``n_missing``: ids in ``after`` that no call has. ``valid`` and ``errors``.
    - ``message``: canonical JSON of the call, its parsed arguments (as text where they are
      no JSON) and its result.

    A schema with a keyword that is not understood is refused with a ValueError. A null or
    empty argument text is an empty object. Rows without a conversation or an id
    are not linked. A null turn counts as -1. Equal rows are calls that repeat an id. Empty
    tables give an empty result. Other columns are not read, so names cannot clash.
    """
    for name, schema in schemas.items():
        check_schema(schema, name)
    calls = calls.select("conv_id", "call_id", F.coalesce("turn", F.lit(-1)).cast("long").alias("turn"), "name", "arguments", "after")
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    nodes = written(
        calls.where(named).groupBy("conv_id", "call_id").agg(F.min("turn").alias("turn"), F.count("*").alias("n_calls")), "calls"
    )
    wanted = calls.where(named).select("conv_id", "call_id", F.explode("after").alias("dep")).where("dep IS NOT NULL").distinct()
    ends = nodes.select("conv_id", F.col("call_id").alias("dep"), F.lit(1).alias("there"))
    checked = written(wanted.join(ends, ["conv_id", "dep"], "left"), "dependencies")
    missing = checked.where("there IS NULL").groupBy("conv_id", "call_id").agg(F.count("*").alias("n_missing"))
    order = waves(nodes, checked.where("there = 1").select("conv_id", "call_id", "dep"))
    facts = nodes.join(order, ["conv_id", "call_id"]).join(missing, ["conv_id", "call_id"], "left").select(
        F.col("conv_id").alias("f_conv"), F.col("call_id").alias("f_call"), "n_calls", "wave", "hop", F.coalesce("n_missing", F.lit(0)).alias("n_missing")
    )
    answers = (
        results.where(named)
        .groupBy(F.col("conv_id").alias("r_conv"), F.col("call_id").alias("r_call"))
        .agg(F.count("*").alias("n_results"), F.min("content").alias("content"))
    )
    # Results beyond the first of their id: equal ones are counted together, then told apart again.
    several = answers.where("n_results > 1").select("r_conv", "r_call", F.col("content").alias("taken"))
    extras = (
        results.where(named)
        .select("conv_id", "call_id", "content")
        .join(several, (F.col("conv_id") == F.col("r_conv")) & (F.col("call_id") == F.col("r_call")))
        .groupBy("conv_id", "call_id", "content", "taken")
        .agg(F.count("*").alias("n"))
        .withColumn("more", F.col("n") - F.when(F.col("content").eqNullSafe(F.col("taken")), 1).otherwise(0))
        .where("more > 0")
        .select("conv_id", "call_id", "content", F.explode(F.sequence(F.lit(1).cast("long"), F.col("more"))).alias("nth"))
    )
    called = nodes.select(F.col("conv_id").alias("f_conv"), F.col("call_id").alias("f_call"))
    extras = extras.join(called, (F.col("conv_id") == F.col("f_conv")) & (F.col("call_id") == F.col("f_call")), "left").select(
        "conv_id", "call_id", F.lit(1).cast("long").alias("n_results"), "content", F.col("f_call").isNotNull().alias("extra")
    )
    loose = results.where(~named).select("conv_id", "call_id", F.lit(1).cast("long").alias("n_results"), "content")
    answered = (F.col("conv_id") == F.col("r_conv")) & (F.col("call_id") == F.col("r_call"))
    linked = calls.join(facts, (F.col("conv_id") == F.col("f_conv")) & (F.col("call_id") == F.col("f_call")), "left").join(answers, answered, "left")
    orphans = (
        answers.join(nodes.select(F.col("conv_id").alias("f_conv"), F.col("call_id").alias("f_call")), (F.col("r_conv") == F.col("f_conv")) & (F.col("r_call") == F.col("f_call")), "left_anti")
        .select(F.col("r_conv").alias("conv_id"), F.col("r_call").alias("call_id"), "n_results", "content")
        .union(loose)
    )
    fields = ["conv_id", "call_id", "turn", "name", "arguments", "n_calls", "wave", "hop", "n_missing", "n_results", "content"]
    both = linked.select(*fields, F.lit(False).alias("orphan")).unionByName(
        orphans.withColumn("orphan", F.lit(True)), allowMissingColumns=True
    )
    both = both.withColumn("extra", F.lit(False)).unionByName(extras.withColumn("orphan", F.lit(True)), allowMissingColumns=True)

    def one(r: dict) -> tuple:
        errors, arguments = [], {}
        if not r["orphan"]:
            try:
                arguments = parsed(r["arguments"] or "{}")
            except (ValueError, RecursionError):
                arguments, errors = r["arguments"], ["$: json"]
            schema = schemas.get(r["name"])
            if not errors:
                errors = ["$: tool"] if schema is None else faults(arguments, schema)
        status = (
            "extra_result" if r["extra"]
            else "orphan_result" if r["orphan"]
            else "no_id" if r["n_calls"] is None
            else "duplicate_id" if r["n_calls"] > 1
            else "cycle" if r["hop"] is None
            else "invalid" if errors
            else "no_result" if r["n_results"] is None
            else "ok"
        )
        message = {"id": r["call_id"], "result": r["content"]}
        if not r["orphan"]:
            message |= {"name": r["name"], "arguments": arguments}
        wave = None if r["hop"] is None else r["wave"]
        valid = None if r["orphan"] else not errors
        return (r["conv_id"], r["call_id"], status, r["n_results"] or 0, wave, r["hop"], r["n_missing"] or 0, valid, errors, canonical(message))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.string()), pa.string()]
        names = [f.split()[0] for f in LINKED.split(", ")]
        for batch in slices(slices(batches, "arguments"), "content"):
            columns = list(zip(*map(one, batch.to_pylist()), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return both.mapInArrow(run, LINKED)
