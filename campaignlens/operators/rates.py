"""Level counts and response rates by category and by bin."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campaignlens.functions.scalars import cut, indicator, number, or_zero, ratio
from campaignlens.operators.quantiles import quantile_columns
from campaignlens.operators.sizing import small_side


def _positive(label: str, positive: str) -> Column:
    return indicator(F.col(label) == positive)


def value_counts(df: DataFrame, c: str) -> DataFrame:
    """Rows and share per level, most frequent first; missing values are not a level."""
    counts = df.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("level")).agg(F.count("*").alias("rows"))
    total = counts.agg(F.sum("rows")).scalar()
    return counts.withColumn("share", ratio(F.col("rows"), total)).orderBy(F.col("rows").desc(), "level")


def level_breakdown(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows and per cent of the table for every level of every column, in one pass."""
    entries = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in cols]
    counts = df.select(F.inline(F.array(*entries))).groupBy("column", "level").agg(F.count("*").alias("rows"))
    total = df.agg(F.count("*")).scalar()
    return counts.filter(F.col("level").isNotNull()).withColumn("pct", ratio(F.col("rows") * 100, total))


def response_share(df: DataFrame, dim: str, label: str = "y", classes: Sequence[str] = ("no", "yes")) -> DataFrame:
    """Share of each class within each level; an absent class has share 0."""
    total = F.count(label)
    return (
        df.filter(F.col(dim).isNotNull())
        .groupBy(F.col(dim).alias("level"))
        .agg(*[or_zero(ratio(F.count(F.when(F.col(label) == v, 1)), total)).alias(v) for v in classes])
    )


def response_rate(df: DataFrame, dim: str, label: str = "y", positive: str = "yes") -> DataFrame:
    """Per cent of positive rows per level, best first."""
    rates = (
        df.filter(F.col(dim).isNotNull())
        .groupBy(F.col(dim).alias("level"))
        .agg(F.count("*").alias("rows"), (F.avg(_positive(label, positive)) * 100).alias("rate"))
    )
    return rates.orderBy(F.col("rate").desc(), "level")


def response_rate_many(df: DataFrame, dims: Sequence[str], label: str = "y", positive: str = "yes") -> DataFrame:
    """The response rate for every level of every dimension, from one scan and one shuffle."""
    slim = df.select(*[F.col(d).cast("string").alias(d) for d in dims], _positive(label, positive).alias("_hit"))
    grouped = slim.groupingSets([[d] for d in dims], *dims).agg(
        *[F.grouping(d).alias(f"_g{i}") for i, d in enumerate(dims)],
        F.count("*").alias("rows"),
        (F.avg("_hit") * 100).alias("rate"),
    )
    dimension, level = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, d in enumerate(dims):
        mine = F.col(f"_g{i}") == 0
        dimension = F.when(mine, F.lit(d)).otherwise(dimension)
        level = F.when(mine, F.col(d)).otherwise(level)
    out = grouped.select(dimension.alias("dimension"), level.alias("level"), "rows", "rate")
    return out.filter(F.col("level").isNotNull())


def overall_rate(df: DataFrame, label: str = "y", positive: str = "yes") -> DataFrame:
    return df.agg(F.count("*").alias("rows"), (F.avg(_positive(label, positive)) * 100).alias("rate"))


def with_lift(df: DataFrame, rates: DataFrame, label: str = "y", positive: str = "yes") -> DataFrame:
    """Rates with the overall rate of ``df`` and their ratio to it."""
    overall = df.agg(F.avg(_positive(label, positive)) * 100).scalar()
    return rates.withColumn("overall", overall).withColumn("lift", ratio(F.col("rate"), F.col("overall")))


def label_table(like: DataFrame, labels: Sequence[str]) -> DataFrame:
    return like.sparkSession.createDataFrame(list(enumerate(labels)), "position int, level string")


def response_rate_binned(
    df: DataFrame,
    c: str,
    edges: Sequence[float],
    labels: Sequence[str],
    label: str = "y",
    positive: str = "yes",
) -> DataFrame:
    """Response rate per right-closed bin, in bin order; an empty bin keeps a row without rate."""
    binned = df.select(cut(c, edges, labels).alias("bin"), _positive(label, positive).alias("hit"))
    rates = binned.groupBy("bin").agg(F.count("*").alias("n"), (F.avg("hit") * 100).alias("rate"))
    bins = label_table(df, labels)
    return (
        bins.join(rates, F.col("level") == F.col("bin"), "left")
        .select("position", F.col("level").alias("bin"), F.coalesce("n", F.lit(0)).cast("long").alias("rows"), "rate")
        .orderBy("position")
    )


def reorder_levels(rates: DataFrame, order: Sequence[str], keep_missing: bool = False) -> DataFrame:
    """Rates in a given level order; levels not in the table are dropped or kept without values."""
    wanted = label_table(rates, order)
    values = [c for c in rates.columns if c != "level"]
    joined = wanted.join(rates, "level", "left" if keep_missing else "inner")
    return joined.select("position", "level", *values).orderBy("position")


def best_worst(rates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Best and worst level with their rates and the distance; the smallest level wins ties."""
    known = rates.filter(F.col("rate").isNotNull())
    best = F.min(F.struct((-F.col("rate")).alias("r"), F.col("level").alias("l")))
    worst = F.min(F.struct(F.col("rate").alias("r"), F.col("level").alias("l")))
    return (
        known.groupBy(*by)
        .agg(best.alias("b"), worst.alias("w"))
        .select(
            *by,
            F.col("b.l").alias("best"),
            (-F.col("b.r")).alias("best_rate"),
            F.col("w.l").alias("worst"),
            F.col("w.r").alias("worst_rate"),
            (-F.col("b.r") - F.col("w.r")).alias("spread"),
        )
    )


def rate_of(rates: DataFrame, level: str) -> DataFrame:
    """The rate of one level."""
    return rates.filter(F.col("level") == level).select("level", "rate")


def rate_gap(rates: DataFrame, a: str, b: str) -> DataFrame:
    """Rates of two levels and their difference."""
    rate = {v: F.max(F.when(F.col("level") == v, F.col("rate"))) for v in (a, b)}
    return rates.agg(rate[a].alias("a_rate"), rate[b].alias("b_rate"), (rate[a] - rate[b]).alias("gap"))


def group_means(df: DataFrame, dim: str, cols: Sequence[str]) -> DataFrame:
    types = dict(df.dtypes)
    return df.groupBy(dim).agg(*[F.avg(number(c, types[c])).alias(c) for c in cols])


# Histograms and box statistics


def same_group(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on the columns ``by`` in which null is a group like any other."""
    renamed = right.withColumnsRenamed({c: f"_same_{c}" for c in by})
    match = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_same_{c}")) for c in by])
    return left.join(renamed, match, how).drop(*[f"_same_{c}" for c in by])


def _bin_rows(counts: DataFrame, bounds: DataFrame, bins: int, by: Sequence[str]) -> DataFrame:
    """Every bin of every group with its edges; bins without rows count 0."""
    frame = bounds.select(*by, "lo", "w", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return same_group(frame, counts, [*by, "bin"], "left").select(
        *by,
        "bin",
        (F.col("lo") + F.col("w") * F.col("bin")).alias("from"),
        (F.col("lo") + F.col("w") * (F.col("bin") + 1)).alias("to"),
        F.coalesce("rows", F.lit(0)).cast("long").alias("rows"),
    )


def histogram(
    df: DataFrame,
    c: str,
    bins: int,
    lo: float | None = None,
    hi: float | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Equal-width counts; the last bin is closed and values out of range are left out.

    Without a range it is the smallest to the largest value, of each group if
    grouped. A single-valued column gets the range value +- 0.5.
    """
    by = list(by)
    v = number(c, dict(df.dtypes)[c])
    slim = df.select(*by, v.alias("v")).filter(F.col("v").isNotNull())
    low = F.min("v") if lo is None else F.lit(float(lo))
    high = F.max("v") if hi is None else F.lit(float(hi))
    found = slim.groupBy(*by).agg(low.alias("a"), high.alias("b"))
    flat = F.col("a") == F.col("b")
    a = F.when(flat, F.col("a") - 0.5).otherwise(F.col("a"))
    b = F.when(flat, F.col("b") + 0.5).otherwise(F.col("b"))
    bounds = found.select(*by, a.alias("lo"), ((b - a) / bins).alias("w"), b.alias("hi"))
    if by:
        bounds = small_side(bounds)
        placed = same_group(slim, bounds, by)
    else:
        one = bounds.select(F.struct("lo", "w", "hi")).scalar()
        placed = slim.withColumn("_b", one).select("v", "_b.*")
    inside = placed.filter((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
    spot = F.least(F.lit(bins - 1), F.floor(ratio(F.col("v") - F.col("lo"), F.col("w")))).cast("int")
    inside = inside.withColumn("_at", spot)
    # The division can be off by one bin at an edge; the edges themselves decide.
    low, high = (F.col("lo") + F.col("w") * (F.col("_at") + i) for i in (0, 1))
    settled = (
        F.when(F.col("v") < low, F.col("_at") - 1)
        .when((F.col("v") >= high) & (F.col("_at") < bins - 1), F.col("_at") + 1)
        .otherwise(F.col("_at"))
    )
    counts = inside.groupBy(*by, settled.alias("bin")).agg(F.count("*").alias("rows"))
    return _bin_rows(counts, bounds, bins, by)


def box_stats(df: DataFrame, c: str, by: Sequence[str] = (), reach: float = 1.5) -> DataFrame:
    """Quartiles, whiskers within ``reach`` interquartile ranges, and the rows beyond them."""
    by = list(by)
    v = number(c, dict(df.dtypes)[c])
    slim = df.select(*by, v.alias("v")).filter(F.col("v").isNotNull())
    found = quantile_columns(slim, ["v"], {"q1": 0.25, "median": 0.5, "q3": 0.75}, by).drop("column")
    span = (F.col("q3") - F.col("q1")) * reach
    fences = found.withColumn("_lo", F.col("q1") - span).withColumn("_hi", F.col("q3") + span)
    if by:
        placed = same_group(slim, small_side(fences), by)
    else:
        one = fences.select(F.struct("q1", "median", "q3", "_lo", "_hi")).scalar()
        placed = slim.withColumn("_f", one).select("v", "_f.*")
    inside = F.when((F.col("v") >= F.col("_lo")) & (F.col("v") <= F.col("_hi")), F.col("v"))
    return placed.groupBy(*by, "q1", "median", "q3").agg(
        F.min(inside).alias("whisker_low"),
        F.max(inside).alias("whisker_high"),
        (F.count("v") - F.count(inside)).alias("outliers"),
        F.count("v").alias("rows"),
    )


def outlier_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows beyond the whiskers, as count and per cent, per column.

    One quantile search serves all columns.
    """
    types = dict(df.dtypes)
    values = df.select(*[number(c, types[c]).alias(c) for c in cols])
    found = quantile_columns(values, cols, {"q1": 0.25, "q3": 0.75})
    span = (F.col("q3") - F.col("q1")) * 1.5
    fences = found.select("column", F.struct((F.col("q1") - span).alias("lo"), (F.col("q3") + span).alias("hi")).alias("f"))
    # One entry per column, so the map is bounded by the column list.
    table = fences.agg(F.map_from_entries(F.collect_list(F.struct("column", "f")))).scalar()
    held = values.withColumn("_f", table)
    row = held.agg(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.count(F.when((F.col(c) < f["lo"]) | (F.col(c) > f["hi"]), 1)).alias("outliers"),
                F.count(c).alias("rows"),
            ).alias(c)
            for c, f in ((c, F.element_at(F.col("_f"), F.lit(c))) for c in cols)
        ]
    )
    out = row.select(F.inline(F.array(*[F.col(c) for c in cols])))
    return out.withColumn("pct", ratio(F.col("outliers") * 100, F.col("rows")))
