"""Cutting a global order into buckets of similar size."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quantile_splits(df: DataFrame, order: str, parts: int) -> tuple[list[float], dict[float, int]]:
    """Bucket boundaries, and how many buckets' worth of rows each hot value holds.

    A hot value is one frequent enough to fill several quantiles; it gets a bucket
    of its own.
    """
    probs = [i / parts for i in range(1, parts)]
    marks = df.approxQuantile(order, probs, 0.25 / parts) if probs else []
    hot = {v: marks.count(v) for v in set(marks) if marks.count(v) > 1}
    cuts = {v for v in marks if math.isfinite(v)}
    cuts |= {math.nextafter(v, math.inf) for v in hot if math.isfinite(v)}
    return [-math.inf, *sorted(cuts), math.inf], hot


def bucket_of(df: DataFrame, order: str, splits: list[float], name: str) -> DataFrame:
    """Adds the bucket number of the value as an int; it grows with the value."""
    out = Bucketizer(splits=splits, inputCol=order, outputCol=name, handleInvalid="keep").transform(df)
    return out.withColumn(name, F.col(name).cast("int"))


def hot_share(splits: list[float], hot: dict[float, int], bucket: str) -> Column:
    """How many buckets' worth of rows the bucket holds: above 1 for that of a hot value."""
    shares = [hot.get(low, 1) for low in splits[:-1]] + [1]  # the last is the bucket of NaN
    return F.element_at(F.expr(f"array({','.join(str(n) for n in shares)})"), F.col(bucket) + 1)
