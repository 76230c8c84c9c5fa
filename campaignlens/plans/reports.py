"""Summary reports assembled from the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campaignlens.operators import profile, rates, rules


def _rows(df: DataFrame, section: str, item: Column, measures: dict[str, Column], text: Column | None = None) -> DataFrame:
    """Long rows ``(section, item, measure, value, text)``, one per measure."""
    none = F.lit(None).cast("string")
    entries = [
        F.struct(F.lit(m).alias("measure"), v.cast("double").alias("value"), (none if text is None else text).alias("text"))
        for m, v in measures.items()
    ]
    return df.select(F.lit(section).alias("section"), item.alias("item"), F.inline(F.array(*entries)))


def eda_summary(df: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Findings as rows: table, target, numeric columns, leading levels, correlations."""
    every = F.lit("all")
    missing = profile.missing_counts(df).agg(F.sum("missing_count").alias("m"), F.max("rows").alias("n"))
    table = _rows(
        missing, "dataset", every, {"rows": F.col("n"), "columns": F.lit(len(df.columns)), "missing": F.col("m")}
    )
    target = _rows(
        rates.value_counts(df, label),
        "target",
        F.col("level"),
        {"rows": F.col("rows"), "pct": F.col("share") * 100},
    )
    balance = rules.imbalance_verdict(df, label)
    balance = _rows(balance, "target", F.lit("imbalance"), {"ratio": F.col("ratio")}, F.col("verdict"))
    spread = profile.range_mean_median(df, numeric)
    spread = _rows(spread, "numeric", F.col("column"), {m: F.col(m) for m in ("min", "max", "mean", "median")})
    skew = rules.skew_verdict(df, numeric)
    skew = _rows(skew, "numeric", F.col("column"), {"skewness": F.col("skewness")}, F.col("verdict"))
    breakdown = rates.level_breakdown(df, categorical)
    lead = breakdown.groupBy("column").agg(
        F.min(F.struct((-F.col("rows")).alias("r"), "level", "pct")).alias("b"), F.count("*").alias("levels")
    )
    lead = _rows(
        lead, "categorical", F.col("column"), {"levels": F.col("levels"), "top_pct": F.col("b.pct")}, F.col("b.level")
    )
    pairs = profile.high_correlation_pairs(df, numeric, threshold=-1.0)
    strongest = pairs.orderBy(F.abs("r").desc_nulls_last(), "f1", "f2").limit(1)
    strongest = _rows(
        strongest, "correlation", F.lit("strongest"), {"r": F.col("r")}, F.concat_ws(" / ", "f1", "f2")
    )
    parts = [table, target, balance, spread, skew, lead, strongest]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def top_factors(
    df: DataFrame,
    contact: str,
    outcome: str,
    outcome_levels: tuple[str, str],
    money: str,
    age: tuple[str, Sequence[float], Sequence[str]],
    campaign: tuple[str, Sequence[float], Sequence[str]],
    label: str = "y",
    positive: str = "yes",
) -> DataFrame:
    """What moves the response: rows ``(factor, item, text, value)``."""

    def rows(table: DataFrame, factor: str, entries: Sequence[tuple[str, Column, Column]]) -> DataFrame:
        made = [
            F.struct(F.lit(i).alias("item"), t.cast("string").alias("text"), v.cast("double").alias("value"))
            for i, t, v in entries
        ]
        return table.select(F.lit(factor).alias("factor"), F.inline(F.array(*made)))

    none = F.lit(None)
    extremes = rates.best_worst(rates.response_rate(df, contact, label, positive))
    by_contact = rows(
        extremes,
        "contact",
        [
            ("best", F.col("best"), F.col("best_rate")),
            ("worst", F.col("worst"), F.col("worst_rate")),
            ("spread", none, F.col("spread")),
        ],
    )
    a, b = outcome_levels
    gap = rates.rate_gap(rates.response_rate(df, outcome, label, positive), a, b)
    by_outcome = rows(
        gap,
        "outcome",
        [("first", F.lit(a), F.col("a_rate")), ("second", F.lit(b), F.col("b_rate")), ("gap", none, F.col("gap"))],
    )
    middle = profile.class_center(df, [money], label)
    by_money = middle.select(
        F.lit("money").alias("factor"),
        F.lit("median").alias("item"),
        F.col(label).cast("string").alias("text"),
        F.col("median").alias("value"),
    )
    binned_age = rates.response_rate_binned(df, *age, label=label, positive=positive)
    best_age = rates.best_worst(binned_age.withColumnRenamed("bin", "level"))
    by_age = rows(best_age, "age", [("best", F.col("best"), F.col("best_rate"))])
    intensity = rates.response_rate_binned(df, *campaign, label=label, positive=positive)
    ends = intensity.filter(F.col("position").isin(0, len(campaign[2]) - 1))
    by_campaign = ends.select(
        F.lit("campaign").alias("factor"), F.lit("rate").alias("item"), F.col("bin").alias("text"), F.col("rate").alias("value")
    )
    out = by_contact
    for part in (by_outcome, by_money, by_age, by_campaign):
        out = out.unionByName(part)
    return out


def headline_segments(df: DataFrame, dims: Sequence[str], label: str = "y", positive: str = "yes") -> DataFrame:
    """Response rate of every level of every dimension, with its lift over the whole."""
    return rates.with_lift(df, rates.response_rate_many(df, dims, label, positive), label, positive)
