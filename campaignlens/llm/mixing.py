"""Mixing sources to target weights by proportionate-fair (Pfair) scheduling.

Every source is cut into blocks of documents. With integer weights q and their sum D,
block i (from 0) of a source may start at slot floor(i*D/q), its release, and must be
placed before slot ceil((i+1)*D/q), its deadline. Each slot goes to the released block
with the earliest deadline (ties: the source named first), so that after any number of
slots every source is less than one block away from its share.

The schedule repeats every D slots, so only one cycle is worked out, by a higher-order
SQL function over D slots; blocks find their slot by arithmetic. When a source has no
blocks left, a new phase begins: the others go on with their own weights, from a fresh
cycle. There are at most as many phases as named sources and the pool of the rest.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from campaignlens.llm.texts import free_name

# Rows of a hash cell in which ranks are counted in one task.
CELL_ROWS = 2_000
# Bounds of the schedule's table: phases x cycle length.
MAX_SOURCES, MAX_CYCLE = 1_000, 10_000


def _int_array(size: Column) -> Column:
    return F.array_repeat(F.lit(0).cast("long"), size.cast("int"))


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def cycle_order(weights: Column) -> Column:
    """One cycle as an array: the source (its index) that each of the sum(weights) slots goes to.

    ``weights`` is an array of longs; a source of weight 0 gets no slot.
    """
    total = F.aggregate(weights, F.lit(0).cast("long"), lambda a, w: a + w)

    def step(state: Column, slot: Column) -> Column:
        # (deadline, source) of each source's next block, if it is released and of this cycle.
        ready = F.transform(
            F.arrays_zip(weights.alias("w"), state["done"].alias("d")),
            lambda x, i: F.when(
                (x["d"] < x["w"]) & (F.floor(x["d"] * total / x["w"]) <= slot),
                F.struct(F.ceil((x["d"] + 1) * total / x["w"]).alias("deadline"), i.alias("source")),
            ),
        )
        return _bind(
            F.array_min(ready)["source"],
            lambda pick: F.struct(
                F.transform(state["done"], lambda d, i: d + F.when(i == pick, 1).otherwise(0)).alias("done"),
                F.concat(state["order"], F.array(pick)).alias("order"),
            ),
        )

    start = F.struct(_int_array(F.size(weights)).alias("done"), F.array().cast("array<int>").alias("order"))
    return F.when(
        total > 0, F.aggregate(F.sequence(F.lit(0).cast("long"), total - 1), start, step)["order"]
    ).otherwise(F.array().cast("array<int>"))


def phase_plan(weights: Column, blocks: Column) -> Column:
    """The phases of the whole mix, as an array of structs.

    ``weights`` and ``blocks`` (blocks per source) are arrays of longs over the sources.
    A phase has its first slot, the weights of the sources that are left, the order of
    its cycle, and how many blocks of each source came before it and by its end.
    """

    def step(state: Column, _: Column) -> Column:
        left = F.zip_with(blocks, state["placed"], lambda n, p: n - p)
        alive = F.zip_with(weights, left, lambda w, r: F.when(r > 0, w).otherwise(0).cast("long"))
        return _bind(
            F.struct(left.alias("left"), alive.alias("w"), cycle_order(alive).alias("order")),
            lambda x: phase(state, x),
        )

    def phase(state: Column, x: Column) -> Column:
        both = F.arrays_zip(x["left"].alias("left"), x["w"].alias("w"))
        cycles = F.array_min(F.transform(both, lambda b: F.when(b["w"] > 0, F.floor(b["left"] / b["w"]))))
        size = F.size(x["order"])
        # Slots of the last, partial cycle: up to the last block of the source that ends first.
        ends = F.transform(
            both,
            lambda b, i: _bind(
                b["left"] - cycles * b["w"],
                lambda rest: F.when(
                    (b["w"] > 0) & (rest < b["w"]),
                    F.when(rest == 0, F.lit(0)).otherwise(
                        F.get(F.filter(F.sequence(F.lit(0), size - 1), lambda t: F.get(x["order"], t) == i), rest.cast("int") - 1)
                        + 1
                    ),
                ),
            ),
        )
        return _bind(
            F.struct(cycles.alias("cycles"), F.slice(x["order"], 1, F.array_min(ends)).alias("part")),
            lambda y: F.when(
                size > 0,
                _bind(
                    F.transform(
                        F.arrays_zip(state["placed"].alias("p"), x["w"].alias("w")),
                        lambda z, i: z["p"] + y["cycles"] * z["w"] + F.size(F.filter(y["part"], lambda s: s == i)),
                    ),
                    lambda placed: F.struct(
                        placed.alias("placed"),
                        (state["slots"] + y["cycles"] * size + F.size(y["part"])).alias("slots"),
                        F.concat(
                            state["phases"],
                            F.array(
                                F.struct(
                                    F.size(state["phases"]).alias("phase"),
                                    state["slots"].alias("start"),
                                    x["w"].alias("w"),
                                    x["order"].alias("order"),
                                    state["placed"].alias("first"),
                                    placed.alias("end"),
                                )
                            ),
                        ).alias("phases"),
                    ),
                ),
            ).otherwise(state),
        )

    phases = "array<struct<phase:int,start:bigint,w:array<bigint>,order:array<int>,first:array<bigint>,end:array<bigint>>>"
    start = F.struct(
        _int_array(F.size(weights)).alias("placed"),
        F.lit(0).cast("long").alias("slots"),
        F.array().cast(phases).alias("phases"),
    )
    return F.aggregate(F.sequence(F.lit(1), F.size(weights)), start, step)["phases"]


def schedule(blocks: DataFrame, weights: list[int]) -> DataFrame:
    """Per source (``no``, an index into ``weights``) its phases, from a table of (no, blocks).

    The result has at most len(weights) rows; a row holds at most len(weights) phases with
    at most sum(weights) offsets, so both bounds are known before any data are read.
    """
    one = blocks.agg(F.map_from_entries(F.collect_list(F.struct("no", "blocks"))).alias("of"))
    counts = F.array(*[F.coalesce(F.element_at("of", F.lit(i)), F.lit(0).cast("long")) for i in range(len(weights))])
    planned = one.select(phase_plan(F.array(*[F.lit(w).cast("long") for w in weights]), counts).alias("phases"))
    per_source = planned.select(F.explode("phases").alias("p")).select("p", F.posexplode("p.w").alias("no", "w")).where("w > 0")
    return (
        per_source.groupBy("no")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "p.phase",
                        "p.start",
                        F.get(F.col("p.first"), F.col("no")).alias("first"),
                        F.get(F.col("p.end"), F.col("no")).alias("end"),
                        "w",
                        F.size("p.order").cast("long").alias("cycle"),
                        F.filter(
                            F.transform(F.col("p.order"), lambda s, t: F.when(s == F.col("no"), t)), lambda t: t.isNotNull()
                        ).alias("offsets"),
                    )
                )
            ).alias("phases")
        )
    )


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str, int],
    rest_weight: int = 1,
    block_docs: int = 64,
    seed: int = 7,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """Every row with its place in a mix of the sources at their target weights.

    ``weights`` are positive integers by source (at most 1,000 sources, sum with
    ``rest_weight`` at most 10,000); all other sources, null among them, are one pool of
    weight ``rest_weight``. Within a source rows come in the order of md5(seed:id), in
    blocks of ``block_docs`` (the last may be smaller).

    Adds ``mix_phase``, ``mix_block`` (within the source), ``mix_release`` and
    ``mix_deadline`` (slots), ``mix_slot`` (the block's place in the whole mix) and
    ``mix_place`` (the row's place in its block); a name the table already has gets
    underscores. Ordering by slot and place gives the mix. No row is left out or repeated.

    A row without an id is ordered by the md5 of all its columns. Rows that repeat an id
    are ordered by a hash of the row; equal rows are interchangeable. An empty table gives
    an empty table; a source without rows takes no slots.
    """
    names = list(weights)
    shares = [*(int(weights[n]) for n in names), int(rest_weight)]
    if min(shares) < 1 or len(shares) > MAX_SOURCES or sum(shares) > MAX_CYCLE or block_docs < 1:
        raise ValueError(f"weights must be positive, at most {MAX_SOURCES} and {MAX_CYCLE} in sum")
    no, draw, cell, offset, rank, plan, cells = (
        free_name(docs, c) for c in ("mix_no", "mix_draw", "mix_cell", "mix_offset", "mix_rank", "mix_plan", "mix_cells")
    )
    phase, block, release, deadline, slot, place = (
        free_name(docs, c) for c in ("mix_phase", "mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_place")
    )
    found = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(source_col)) if names else F.lit(0)
    position = F.coalesce(found, F.lit(0)).cast("int")
    whole_row = F.to_json(F.struct(*[F.col(c) for c in docs.columns]))
    keyed = docs.withColumns(
        {
            no: F.when(position > 0, position - 1).otherwise(len(names)),
            draw: F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.md5(whole_row)))),
        }
    )

    # Rows per source: at most one row per weight.
    totals = keyed.groupBy(F.col(no).alias("no")).agg(F.count("*").alias("n"))
    planned = schedule(totals.select("no", F.ceil(F.col("n") / block_docs).alias("blocks")), shares)
    by_source = totals.join(F.broadcast(planned), "no").select(
        F.col("no").alias(no), F.ceil(F.col("n") / CELL_ROWS).alias(cells), F.col("phases").alias(plan)
    )

    # Ranks within a source: rows are counted per cell of the draw, ranked inside the cell.
    unit = F.conv(F.substring(draw, 1, 8), 16, 10).cast("long")
    celled = keyed.join(F.broadcast(by_source.select(no, cells)), no).withColumn(
        cell, F.floor(unit * F.col(cells) / F.lit(1 << 32))
    )
    sizes = celled.groupBy(no, cell).agg(F.count("*").alias("n"))
    before = W.partitionBy(no).orderBy(cell).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(no, cell, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(offset))
    inside = W.partitionBy(no, cell).orderBy(draw, id_col, F.xxhash64(*docs.columns))
    ranked = celled.join(offsets, [no, cell]).withColumn(rank, F.row_number().over(inside) - 1 + F.col(offset))

    blocked = ranked.join(F.broadcast(by_source.select(no, plan)), no).withColumn(block, F.floor(F.col(rank) / block_docs))
    mine = F.filter(F.col(plan), lambda p: (p["first"] <= F.col(block)) & (F.col(block) < p["end"]))[0]
    p, i = F.col(plan), F.col(block) - F.col(plan)["first"]
    return blocked.withColumn(plan, mine).select(
        *docs.columns,
        p["phase"].alias(phase),
        F.col(block),
        (p["start"] + F.floor(i * p["cycle"] / p["w"])).alias(release),
        (p["start"] + F.ceil((i + 1) * p["cycle"] / p["w"])).alias(deadline),
        (p["start"] + F.floor(i / p["w"]) * p["cycle"] + F.get(p["offsets"], (i % p["w"]).cast("int"))).alias(slot),
        (F.col(rank) % block_docs).alias(place),
    )
