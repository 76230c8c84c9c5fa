"""The Euclidean silhouette of drawn rows against all rows, with its standard error."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campaignlens.functions.draws import draw
from campaignlens.operators.pivots import blocks, exact, squares

DRAWN = 2000


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all pairs; those too small for products are measured directly."""
    rough, error = squares(a, b)
    out = np.sqrt(np.maximum(rough, 0))
    who, where = np.nonzero(rough <= 1e6 * error[:, None])
    for i in range(0, len(who), 1 << 16):
        one, other = who[i : i + (1 << 16)], where[i : i + (1 << 16)]
        out[one, other] = exact(a[one], b[other])
    return out


def silhouettes(df: DataFrame, key: str, features: str = "features", cluster: str = "cluster", drawn: int = DRAWN, seed: int = 42) -> DataFrame:
    """Rows ``(key, cluster, inner, outer, silhouette)`` of the drawn rows.

    ``inner`` is the mean distance to the other rows of the own cluster, ``outer`` the smallest
    mean distance to another cluster, both over all rows. A row alone in its cluster has 0; with
    a single cluster all are null. ``features`` is a vector or an array, rows without a cluster
    are left out. The drawn rows go to every task, which holds their sums per cluster: memory is
    bounded by ``drawn`` times the clusters.
    """
    kind = dict(df.dtypes)[features]
    x = vector_to_array(features) if kind == "vector" else F.col(features).cast("array<double>")
    rows = df.filter(F.col(cluster).isNotNull()).select(F.col(key).alias("key"), x.alias("x"), F.col(cluster).cast("long").alias("cluster"))
    picked = rows.orderBy(draw("key", seed)).limit(drawn).collect()
    schema = f"place int, key {dict(rows.dtypes)['key']}, own long"
    known = df.sparkSession.createDataFrame([(i, r["key"], r["cluster"]) for i, r in enumerate(picked)], schema)
    asked = np.array([r["x"] for r in picked], np.float64)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        count: dict[int, int] = {}
        for batch in batches:
            for c, at in batch.groupby("cluster").indices.items():
                points = np.stack(batch["x"].to_numpy()[at]).astype(np.float64)
                held = total.setdefault(int(c), np.zeros(len(asked)))
                for part in blocks(len(points), len(asked)):
                    held += _distances(asked, points[part]).sum(axis=1)
                count[int(c)] = count.get(int(c), 0) + len(points)
        for c, held in total.items():
            yield pd.DataFrame({"place": np.arange(len(asked), dtype=np.int32), "cluster": c, "total": held, "n": count[c]})

    found = rows.select("x", "cluster").mapInPandas(sums, "place int, cluster long, total double, n long") if picked else (
        df.sparkSession.createDataFrame([], "place int, cluster long, total double, n long")
    )
    per = found.groupBy("place", "cluster").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).join(known, "place")
    own = F.col("cluster") == F.col("own")
    both = per.groupBy("place").agg(
        F.any_value("key").alias(key),
        F.any_value("own").alias(cluster),
        F.max(F.when(own, F.try_divide("total", F.col("n") - 1))).alias("inner"),
        F.min(F.when(~own, F.try_divide("total", "n"))).alias("outer"),
    )
    gap = F.coalesce(F.try_divide(F.col("outer") - F.col("inner"), F.greatest("inner", "outer")), F.lit(0.0))
    value = F.when(F.col("outer").isNotNull(), F.when(F.col("inner").isNull(), F.lit(0.0)).otherwise(gap))
    return both.select(key, cluster, "inner", "outer", value.alias("silhouette"))


def euclidean_silhouette(df: DataFrame, key: str, features: str = "features", cluster: str = "cluster", drawn: int = DRAWN, seed: int = 42) -> DataFrame:
    """One row ``(silhouette, error, rows)``: the mean over the drawn rows and its standard error, which is 0 when all rows are drawn."""
    found = silhouettes(df, key, features, cluster, drawn, seed)
    everything = df.filter(F.col(cluster).isNotNull()).agg(F.count("*")).scalar()
    left = F.greatest(1 - F.try_divide(F.count("silhouette").cast("double"), everything), F.lit(0.0))
    error = F.sqrt(F.try_divide(F.var_samp("silhouette"), F.count("silhouette").cast("double")) * left)
    return found.agg(F.avg("silhouette").alias("silhouette"), error.alias("error"), F.count("silhouette").alias("rows"))
