"""Verdicts, tiers and projections from the tables of the other operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campaignlens.functions.draws import draw
from campaignlens.functions.moments import sample_skewness
from campaignlens.functions.scalars import indicator, number, ratio
from campaignlens.operators.rates import value_counts


def imbalance_verdict(df: DataFrame, label: str) -> DataFrame:
    """Largest class over second largest: above 3 severe, above 1.5 moderate, else balanced."""
    leaders = value_counts(df, label).limit(2)
    first, second = F.max("rows"), F.when(F.count("*") > 1, F.min("rows"))
    out = leaders.agg(ratio(first, second).alias("ratio"))
    verdict = F.when(F.col("ratio") > 3, "severe").when(F.col("ratio") > 1.5, "moderate").otherwise("balanced")
    return out.withColumn("verdict", verdict)


def skew_verdict(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Absolute skewness above 1 high, above 0.5 moderate, else normal."""
    types = dict(df.dtypes)
    row = df.agg(*[sample_skewness(number(c, types[c])).alias(c) for c in cols])
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).alias("skewness")) for c in cols]
    size = F.abs("skewness")
    verdict = F.when(size > 1, "high").when(size > 0.5, "moderate").otherwise("normal")
    return row.select(F.inline(F.array(*pairs))).withColumn("verdict", verdict)


def propensity_tier(df: DataFrame, score: str, name: str = "tier") -> DataFrame:
    """Adds the contact tier: above 0.6 high, from 0.3 medium, below low."""
    tier = F.when(F.col(score) > 0.6, "high").when(F.col(score) >= 0.3, "medium")
    return df.withColumn(name, F.when(F.col(score).isNotNull(), tier.otherwise("low")))


def campaign_projection(
    df: DataFrame, label: str = "y", positive: str = "yes", target: float = 0.5, lift: float = 2.0
) -> DataFrame:
    """Contacts, conversions and efficiency with and without targeting.

    The lift is an assumption: the product of ``target`` and ``lift`` above 1 would
    promise more conversions than there are responders.
    """
    base = df.agg(F.count("*").alias("n"), F.avg(indicator(F.col(label) == positive)).alias("r"))
    n, r = F.col("n").cast("double"), F.col("r")
    plans = [("everyone", n, n * r), ("targeted", n * target, n * target * r * lift)]
    rows = [
        F.struct(
            F.lit(name).alias("plan"),
            contacts.alias("contacts"),
            won.alias("conversions"),
            ratio(won * 100, contacts).alias("efficiency_pct"),
        )
        for name, contacts, won in plans
    ]
    return base.select(F.inline(F.array(*rows)))


def assign_arm(df: DataFrame, key: str, seed: int = 42, arms: Sequence[str] = ("model", "random")) -> DataFrame:
    """Adds the test arm of each row, an even split by the draw of its key."""
    spot = F.conv(F.substring(draw(key, seed), 1, 8), 16, 10).cast("long") % len(arms)
    return df.withColumn("arm", F.element_at(F.array(*[F.lit(a) for a in arms]), (spot + 1).cast("int")))


def ab_test(
    df: DataFrame, score: str, threshold: float, key: str, label: str = "y", positive: str = "yes", seed: int = 42
) -> DataFrame:
    """Response rate of rows contacted on the model's word and of rows contacted at random.

    In the model arm only rows at or above the threshold are contacted; the other
    arm contacts every row it was given.
    """
    armed = assign_arm(df, key, seed)
    contacted = armed.filter((F.col("arm") == "random") | (F.col(score) >= threshold))
    return contacted.groupBy("arm").agg(
        F.count("*").alias("contacted"),
        F.count(F.when(F.col(label) == positive, 1)).alias("responses"),
        (F.avg(indicator(F.col(label) == positive)) * 100).alias("rate"),
    )
