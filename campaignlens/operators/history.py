"""Contact history per client: how many earlier contacts, how long ago, with what outcome."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from campaignlens.functions.times import micros
from campaignlens.operators.buckets import bucket_of, hot_share, quantile_splits
from campaignlens.operators.sizing import shuffle_width
from campaignlens.session import written

HOT_ROWS = 5_000_000


def hot_keys(df: DataFrame, key: str, limit: int) -> DataFrame:
    """Keys (column ``_hot``, null may be one) with more than ``limit`` rows; at most ``rows / limit`` of them exist."""
    counts = df.groupBy(F.col(key).alias("_hot")).agg(F.count("*").alias("n")).filter(F.col("n") > limit)
    return written(counts.select("_hot", F.lit(True).alias("_is_hot")), "hot-keys")


def with_history(
    df: DataFrame,
    client: str,
    when: str,
    key: str,
    outcome: str,
    none_days: int = -1,
    none_outcome: str = "unknown",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Adds ``previous``, ``pdays`` and ``poutcome`` from the client's earlier rows.

    Rows of a client run by ``when`` and then ``key``, which must be unique and
    numeric. Clients with more than ``hot_rows`` rows, the missing client among
    them, are worked in slices of their timeline, so that no task holds a whole
    such client.
    """
    hot = hot_keys(df, client, hot_rows)
    if hot.isEmpty():
        joined = _whole(df, client, when, key, outcome)
    else:
        # Hot keys meet their rows in a join: there may be too many of them for a list.
        of_hot = F.col(client).eqNullSafe(F.col("_hot"))
        joined = _whole(df.join(hot, of_hot, "left_anti"), client, when, key, outcome).unionByName(
            _sliced(df.join(hot, of_hot, "left_semi"), client, when, key, outcome)
        )
    days = F.datediff(F.col(when).cast("date"), F.col("_when").cast("date")).cast("long")
    return joined.select(
        *df.columns,
        F.col("_earlier").cast("long").alias("previous"),
        F.coalesce(days, F.lit(none_days).cast("long")).alias("pdays"),
        F.when(F.col("_earlier") == 0, F.lit(none_outcome)).otherwise(F.col("_outcome")).alias("poutcome"),
    )


def _along(window: WindowSpec, when: str, outcome: str) -> list:
    return [
        (F.row_number().over(window) - 1).alias("_earlier"),
        F.lag(when).over(window).alias("_when"),
        F.lag(outcome).over(window).alias("_outcome"),
    ]


def _whole(df: DataFrame, client: str, when: str, key: str, outcome: str) -> DataFrame:
    return df.select("*", *_along(W.partitionBy(client).orderBy(when, key), when, outcome))


def _sliced(df: DataFrame, client: str, when: str, key: str, outcome: str) -> DataFrame:
    """The same columns from windows inside slices, carried on from slice to slice."""
    parts = max(2, shuffle_width(df))
    work = df.withColumn("_at", micros(when, dict(df.dtypes)[when]).cast("double"))
    splits, crowded = quantile_splits(work, "_at", parts)
    work = bucket_of(work, "_at", splits, "_b")
    work = work.withColumn("_k", F.col(key).cast("double"))
    if crowded:
        # A moment that holds very many rows is cut by key range as well.
        at_crowded = hot_share(splits, crowded, "_b") > 1
        key_splits, _ = quantile_splits(work.filter(at_crowded), "_k", parts)
        work = bucket_of(work, "_k", key_splits, "_s").withColumn("_s", F.when(at_crowded, F.col("_s")).otherwise(0))
    else:
        work = work.withColumn("_s", F.lit(0))

    cut = [client, "_b", "_s"]
    local = work.select("*", *_along(W.partitionBy(*cut).orderBy(when, key), when, outcome))
    last = F.max(F.struct(F.col(when).alias("t"), F.col(key).alias("k"), F.col(outcome).alias("o")))
    slices = work.groupBy(*cut).agg(F.count("*").alias("_size"), last.alias("_last"))
    # Per client there are only a few slices per shuffle partition.
    order = W.partitionBy(client).orderBy("_b", "_s")
    slices = slices.select(
        *cut,
        F.coalesce(F.sum("_size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"),
        F.lag("_last").over(order).alias("_prior"),
    )
    first = F.col("_earlier") == 0
    slices = slices.withColumnsRenamed({c: f"_cut_{c}" for c in cut})
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_cut_{c}")) for c in cut])
    return local.join(slices, same).select(
        *df.columns,
        (F.col("_ahead") + F.col("_earlier")).alias("_earlier"),
        F.when(first, F.col("_prior.t")).otherwise(F.col("_when")).alias("_when"),
        F.when(first, F.col("_prior.o")).otherwise(F.col("_outcome")).alias("_outcome"),
    )
