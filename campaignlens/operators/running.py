"""Running totals and ranks over a global order, without a one-task window.

The order column is cut at approximate quantiles into buckets of similar size.
Each bucket is summed, the few bucket totals give each bucket its offset, and
the window runs inside the buckets. A value so frequent that it fills several
quantiles gets a bucket to itself, split further by the random draw of the row
key, so one value may hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from campaignlens.functions.draws import draw, draw_unit
from campaignlens.operators.buckets import bucket_of, hot_share, quantile_splits
from campaignlens.operators.sizing import shuffle_width


def running(
    df: DataFrame,
    order: str,
    sums: Mapping[str, Column],
    descending: bool = False,
    key: str | None = None,
    seed: int = 0,
    parts: int | None = None,
) -> DataFrame:
    """Adds a running total for each entry of ``sums`` along the order column.

    Rows run by ``order`` and, among equal values, by the draw of ``key``; without
    a key the order column must be unique. Also adds ``position``, counted from 1,
    and ``before``, the number of rows with a strictly smaller (or, descending,
    greater) value. Rows with a null order value are left out.
    """
    parts = parts or shuffle_width(df)
    df = df.withColumn("_v", F.col(order).cast("double")).filter(F.col("_v").isNotNull())
    splits, hot = quantile_splits(df, "_v", parts)
    work = bucket_of(df, "_v", splits, "_b")
    share = hot_share(splits, hot, "_b")
    # Whole numbers beyond 2^53 that share a double: how far each is from it, at most 1,024 values.
    kind = dict(df.dtypes)[order]
    apart = F.coalesce(F.col(order) - F.col("_v").try_cast("long"), F.lit(0)) if kind == "bigint" else F.lit(0)
    work = work.withColumn("_d", F.when(share > 1, apart).otherwise(0).cast("long"))
    if key is None:
        work = work.withColumn("_s", F.lit(0))
    else:
        # Equal rows are split evenly by their uniform draw.
        spread = F.floor(draw_unit(key, seed) * share * 2).cast("int")
        work = work.withColumn("_t", draw(key, seed)).withColumn("_s", F.when(share > 1, spread).otherwise(0))
    for name, c in sums.items():
        work = work.withColumn(f"_x_{name}", c)

    bucket_order = F.col("_b").desc() if descending else F.col("_b").asc()
    apart_order = F.col("_d").desc() if descending else F.col("_d").asc()
    cut = ["_b", "_d", "_s"]
    along = W.orderBy(bucket_order, apart_order, "_s").rowsBetween(W.unboundedPreceding, -1)
    # A few rows per bucket: at most three per shuffle partition, more only where values share a double.
    totals = work.groupBy(*cut).agg(
        F.count("*").alias("_n"),
        *[F.sum(f"_x_{name}").alias(f"_o_{name}") for name in sums],
    )
    zero = F.lit(0)
    offsets = totals.select(
        *cut,
        F.coalesce(F.sum("_n").over(along), zero).alias("_off"),
        *[F.coalesce(F.sum(f"_o_{name}").over(along), zero).alias(f"_off_{name}") for name in sums],
    ).withColumn("_bfirst", F.min("_off").over(W.partitionBy("_b", "_d")))

    # The double only finds the bucket, it never decreases as the value grows; the value itself orders the rows.
    value_order = F.col(order).desc() if descending else F.col(order).asc()
    ordering = [value_order, F.col("_t").asc()] if key is not None else [value_order]
    inside = W.partitionBy(*cut).orderBy(*ordering)
    rows = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    out = work.withColumn("_pos", F.row_number().over(inside))
    out = out.withColumn("_rank", F.rank().over(W.partitionBy(*cut).orderBy(value_order)))
    for name in sums:
        out = out.withColumn(f"_r_{name}", F.sum(f"_x_{name}").over(rows))
    # Offsets have a bounded number of rows by construction, whatever the input.
    out = out.join(F.broadcast(offsets), cut)
    return out.select(
        *[c for c in df.columns if c != "_v"],
        *[(F.col(f"_off_{name}") + F.col(f"_r_{name}")).alias(name) for name in sums],
        (F.col("_off") + F.col("_pos")).alias("position"),
        F.when(share > 1, F.col("_bfirst"))
        .otherwise(F.col("_off") + F.col("_rank") - 1)
        .cast("long")
        .alias("before"),
    )
