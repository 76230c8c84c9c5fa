"""Exact quantiles with linear interpolation, by selecting all wanted ranks at once.

A sketch pass brackets each wanted rank of each group and column. One more pass counts rows
by value inside the brackets and only as a total between them; the totals tell which
cells hold the wanted ranks. Cells with many values are cut at the quantiles of their
values and counted again, round after round, until every cell that holds a wanted rank is
small; then ranks are counted inside the cells. Only cells with a wanted rank go on to
the next round. The answer is exact: where a rank lies outside its bracket all the same,
the brackets are widened and counted again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from campaignlens.functions.scalars import number
from campaignlens.session import discard, written

CELL_ROWS = 50_000  # distinct values ranked in one task; a group of so few rows is one cell
CUTS = 256  # parts that a large cell is cut into
ACCURACY = 10_000
MARGIN = 3.0  # bracket half-width in units of the sketch error


def quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    cell_rows: int = CELL_ROWS,
    accuracy: int = ACCURACY,
    margin: float = MARGIN,
) -> DataFrame:
    """Rows ``(by..., column, prob, value)``; a group without values has no row."""
    cols, probs, by = list(cols), [float(p) for p in probs], list(by)
    if not cols or not probs:
        return df.sparkSession.createDataFrame([], df.select(*by).schema.add("column", "string").add("prob", "double").add("value", "double"))
    cells = selected(df, cols, probs, by, cell_rows, accuracy, margin)
    keys = [*by, "i"]
    inside = W.partitionBy(*keys, "base").orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = cells.withColumn("upto", F.col("base") + F.sum("rows").over(inside)).withColumn("before", F.col("upto") - F.col("rows"))

    def at(p: float) -> Column:
        """The value at p, between the ranks around p * (n - 1)."""
        spot = F.lit(p) * (F.col("n") - 1)
        low = F.floor(spot)
        first, second = (
            F.max(F.when((F.col("before") <= rank) & (rank < F.col("upto")), F.col("v"))) for rank in (low, low + 1)
        )
        part = F.max(spot - low)
        return F.when(part > 0, first + (second - first) * part).otherwise(first)

    found = ranked.groupBy(*keys).agg(F.array(*[at(p) for p in probs]).alias("q"))
    names = F.array(*[F.lit(c) for c in cols])
    pairs = [F.struct(F.lit(p).alias("prob"), F.col("q")[j].alias("value")) for j, p in enumerate(probs)]
    return found.select(*by, names[F.col("i")].alias("column"), F.inline(F.array(*pairs)))


def selected(
    df: DataFrame, cols: list[str], probs: list[float], by: list[str], cell_rows: int, accuracy: int, margin: float
) -> DataFrame:
    """Rows (by..., i, n, base, v, rows): the values and their counts in all cells that hold a wanted rank.

    ``i`` is the column's place, ``n`` the values of its group, ``base`` how many of them
    come before the cell. A cell has at most about ``cell_rows`` distinct values.
    """
    types, keys, cell_rows = dict(df.dtypes), [*by, "i"], max(1, cell_rows)
    entries = [F.struct(F.lit(i).alias("i"), number(c, types[c]).alias("v")) for i, c in enumerate(cols)]
    long = df.select(*by, F.inline(F.array(*entries))).filter(F.col("v").isNotNull())
    while True:
        counted = written(_bracketed(long, probs, by, cell_rows, accuracy, margin), "brackets")
        wanted = _wanted(counted, keys, probs)
        row = wanted.agg(F.max("held"), F.coalesce(F.bool_or("outside"), F.lit(False))).first()
        if not row[1]:
            break
        discard(counted)
        margin = margin * 8 + 1
    while True:
        kept = _joined(counted, wanted, [*keys, "base", "cell"])
        kept = kept.select(*keys, "n", F.col("before").alias("base"), "v", "rows")
        if (row[0] or 0) <= cell_rows:
            return kept
        # A cut between the quantiles of a cell's values: at least two parts, as it has many values.
        kept = written(kept, "cells")
        marks = [j / CUTS for j in range(1, CUTS)]
        cuts = kept.groupBy(*keys, "base").agg(F.percentile_approx("v", marks, ACCURACY).alias("cuts"))
        cell = F.size(F.filter("cuts", lambda c: c <= F.col("v")))
        done = counted
        counted = written(_joined(kept, cuts, [*keys, "base"]).select(*keys, "n", "base", cell.alias("cell"), "v", "rows"), "cells")
        discard(done)
        discard(kept)
        wanted = _wanted(counted, keys, probs)
        row = wanted.agg(F.max("held")).first()


def _joined(rows: DataFrame, side: DataFrame, keys: list[str]) -> DataFrame:
    """Null-safe join on the keys, one row of ``side`` per key: a null in a grouping column is a group of its own."""
    side = side.select(*[F.col(k).alias(f"k_{k}") for k in keys], *[c for c in side.columns if c not in rows.columns])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"k_{k}"))
    return rows.join(side, on).drop(*[f"k_{k}" for k in keys])


def _bracketed(long: DataFrame, probs: list[float], by: list[str], cell_rows: int, accuracy: int, margin: float) -> DataFrame:
    """Rows (by..., i, n, base, cell, v, rows): counts by value inside the brackets, by cell (v null) between them."""
    half, keys = margin / accuracy, [*by, "i"]
    marks = [max(0.0, p - half) for p in probs] + [min(1.0, p + half) for p in probs]
    sketch = long.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("v", marks, accuracy).alias("b"))
    v, b = F.col("v"), F.col("b")
    reached = sum((F.when(b[j] <= v, 1).otherwise(0) for j in range(len(probs))), F.lit(0))
    passed = sum((F.when(b[len(probs) + j] < v, 1).otherwise(0) for j in range(len(probs))), F.lit(0))
    whole = F.col("n") <= F.lit(cell_rows)
    return (
        _joined(long, sketch, keys)
        .select(
            *keys,
            "n",
            F.lit(0).cast("long").alias("base"),
            F.when(whole, 0).otherwise(reached + passed).alias("cell"),
            F.when(whole | (reached > passed), v).alias("v"),
        )
        .groupBy(*keys, "n", "base", "cell", "v")
        .agg(F.count("*").alias("rows"))
    )


def _wanted(counted: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """The cells that hold a wanted rank: (keys, base, cell, before, held, outside).

    There are at most CUTS cells, or two per wanted rank and one, beside each other.
    """
    totals = counted.groupBy(*keys, "n", "base", "cell").agg(
        F.sum("rows").alias("in_cell"), F.count("v").alias("held"), F.bool_or(F.col("v").isNull()).alias("outside")
    )
    along = W.partitionBy(*keys, "base").orderBy("cell").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = totals.withColumn("upto", F.col("base") + F.sum("in_cell").over(along)).withColumn("before", F.col("upto") - F.col("in_cell"))
    hit = F.lit(False)
    for p in probs:
        spot = F.lit(p) * (F.col("n") - 1)
        for rank in (F.floor(spot), F.ceil(spot)):
            hit = hit | ((F.col("before") <= rank) & (rank < F.col("upto")))
    return placed.where(hit).select(*keys, "base", "cell", "before", "held", "outside")


def quantile_columns(
    df: DataFrame, cols: Sequence[str], probs: dict[str, float], by: Sequence[str] = (), **limits: int
) -> DataFrame:
    """One row per group and column, with one output column per named probability."""
    long = quantiles(df, cols, list(probs.values()), by, **limits)
    return long.groupBy(*by, "column").agg(
        *[F.max(F.when(F.col("prob") == F.lit(float(p)), F.col("value"))).alias(name) for name, p in probs.items()]
    )
