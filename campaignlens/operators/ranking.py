"""Sorted reports: cumulative shares, top rows, ranked prospects."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campaignlens.functions.scalars import ratio
from campaignlens.operators.prep import within_draw
from campaignlens.operators.running import running
from campaignlens.session import written


def cumulative_share(df: DataFrame, key: str, measure: str, seed: int = 0) -> DataFrame:
    """Running total of the measure, largest first, and its share of the whole."""
    slim = written(df.select(key, measure), "measures")
    total = slim.agg(F.sum(measure)).scalar()
    out = running(slim, measure, {"cumulative": F.col(measure)}, descending=True, key=key, seed=seed)
    return out.select(key, measure, "position", "cumulative", ratio(F.col("cumulative"), total).alias("share"))


def rows_to_reach(shares: DataFrame, thresholds: list[float]) -> DataFrame:
    """How many leading rows it takes to reach each share of the whole.

    A prefix that equals the share exactly is counted as not yet enough.
    """
    counts = shares.agg(*[F.count(F.when(F.col("share") <= t, 1)).alias(f"n{i}") for i, t in enumerate(thresholds)])
    pairs = [
        F.struct(F.lit(float(t)).alias("threshold"), (F.col(f"n{i}") + 1).alias("rows"))
        for i, t in enumerate(thresholds)
    ]
    return counts.select(F.inline(F.array(*pairs)))


def sort_by(df: DataFrame, measure: str, key: str, descending: bool = True) -> DataFrame:
    """All rows by the measure, equal ones by key."""
    return df.orderBy(F.col(measure).desc() if descending else F.col(measure).asc(), key)


def sort_by_size(df: DataFrame, measure: str, key: str) -> DataFrame:
    """All rows by the absolute value of the measure, largest first."""
    return df.orderBy(F.abs(measure).desc(), key)


def top(df: DataFrame, measure: str, key: str, k: int = 10) -> DataFrame:
    return sort_by(df, measure, key).limit(k)


def bottom(df: DataFrame, measure: str, key: str, k: int = 5) -> DataFrame:
    return sort_by(df, measure, key, descending=False).limit(k)


def _tile(position: Column, rows: Column, tiles: int) -> Column:
    """Tile number of a position when the first tiles take the odd rows."""
    small = F.floor(rows / tiles)
    odd = rows % tiles
    head = odd * (small + 1)
    in_head = F.floor((position - 1) / (small + 1))
    in_tail = odd + F.floor(ratio(position - 1 - head, small))
    return (F.when(position <= head, in_head).otherwise(in_tail) + 1).cast("long")


def rank_prospects(scored: DataFrame, score: str, key: str, tiles: int = 10, seed: int = 0) -> DataFrame:
    """Position, percentile rank and tile of every row, best score first.

    Equal scores share a percentile rank and are placed in draw order.
    """
    slim = written(scored.select(key, score), "scores")
    rows = slim.agg(F.count(score)).scalar()
    out = running(slim, score, {}, descending=True, key=key, seed=seed).withColumn("_n", rows)
    return out.select(
        key,
        score,
        "position",
        F.coalesce(ratio(F.col("before"), F.col("_n") - 1), F.lit(0.0)).alias("percent_rank"),
        _tile(F.col("position"), F.col("_n"), tiles).alias("tile"),
    )


def top_share(scored: DataFrame, score: str, key: str, share: float, seed: int = 0) -> DataFrame:
    """The best-scored part of the table: the first ceil(share * rows) rows."""
    slim = written(scored.select(key, score), "scores")
    rows = slim.agg(F.count(score)).scalar()
    ranked = running(slim, score, {}, descending=True, key=key, seed=seed)
    return ranked.filter(F.col("position") <= F.ceil(rows * F.lit(share))).select(key, score, "position")


MARKS = 64  # thresholds tried in one round


def kth_largest(values: DataFrame, c: str, k: int) -> float | None:
    """The largest value that at least ``k`` rows reach, None if there are fewer rows.

    Every round counts the rows from each of MARKS sketched values of the open interval up,
    and goes on between the two that enclose rank k. Counts are exact and merge by adding.
    """
    v, low, high = F.col(c), None, None
    while True:
        inside = F.lit(True) if low is None else v >= F.lit(low)
        inside = inside if high is None else inside & (v < F.lit(high))
        marks = values.agg(F.percentile_approx(F.when(inside, v), [i / MARKS for i in range(MARKS + 1)], 10_000)).first()[0]
        marks = sorted(set(marks or ()))
        if not marks:
            return None
        if marks == [low]:
            return low
        counts = values.agg(*[F.count_if(v >= F.lit(m)).alias(f"n{i}") for i, m in enumerate(marks)]).first()
        reached = [m for m, n in zip(marks, counts, strict=True) if n >= k]
        missed = [m for m, n in zip(marks, counts, strict=True) if n < k]
        if not reached:
            return None
        low, high = reached[-1], min(missed, default=high)


def choose_share(scored: DataFrame, score: str, key: str, share: float, seed: int = 0) -> DataFrame:
    """The rows of :func:`top_share` without their positions, by a threshold instead of ranks.

    The score of the last row wanted is found by counting. The table is then only filtered;
    among rows of just that score, the draw of their key decides. Rows without a score stay out.
    """
    slim = written(scored.select(key, F.col(score).cast("double").alias(score)).where(F.col(score).isNotNull()), "scores")
    rows = slim.count()
    wanted = min(rows, max(0, math.ceil(rows * share)))
    if not wanted:
        return slim.limit(0)
    mark = F.lit(kth_largest(slim, score, wanted))
    above = slim.where(F.col(score) > mark).count()
    _, first = within_draw(slim.where(F.col(score) == mark), lambda classes: F.lit(wanted - above), key, seed)
    return slim.where((F.col(score) > mark) | ((F.col(score) == mark) & first))
