"""k-means segmentation and one-pass segment profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from uuid import uuid4

from pyspark.ml.clustering import KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.mllib.common import _py2java
from pyspark.mllib.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from campaignlens.functions.scalars import indicator, number, ratio
from campaignlens.operators.means import Means, fit_many
from campaignlens.operators.passes import Blocks
from campaignlens.operators.prep import placed, spread
from campaignlens.operators.rates import best_worst
from campaignlens.operators.silhouette import DRAWN, euclidean_silhouette

HIGH, MODERATE, LOW = "HIGH-VALUE PROSPECTS", "MODERATE PROSPECTS", "LOW ENGAGEMENT"


def _model(df: DataFrame, features: str, found: Means) -> KMeansModel:
    """MLlib's model with the fitted centres and a summary."""
    context = df.sparkSession.sparkContext
    ml = context._jvm.org.apache.spark.ml.clustering
    centres = _py2java(context, [Vectors.dense(c) for c in found.centres])
    model = ml.KMeansModel(f"KMeans_{uuid4().hex[:12]}", context._jvm.org.apache.spark.mllib.clustering.KMeansModel(centres))
    model.setFeaturesCol(features)
    model.setPredictionCol("cluster")
    model.set(model.k(), len(found.centres))
    summary = ml.KMeansSummary(model.transform(df._jdf), "cluster", features, len(found.centres), found.iterations, found.cost)
    model.setSummary(context._jvm.scala.Option.apply(summary))
    fitted = KMeansModel(model)
    fitted._transfer_params_from_java()
    return fitted


def _fit(df: DataFrame, features: str, ks: Sequence[int], starts: int, seed: int, max_iter: int) -> dict[int, KMeansModel]:
    """For each k the best of its starts by within-cluster squared distance; every pass over the rows serves all of them."""
    kind = dict(df.dtypes)[features]
    blocks = Blocks(df.select(vector_to_array(features).alias("x") if kind == "vector" else F.col(features).cast("array<double>").alias("x")), "x")
    try:
        wanted = [(k, seed + i) for k in ks for i in range(starts)]
        fitted = fit_many(blocks, wanted, max_iter, seed)
    finally:
        blocks.drop()
    best: dict[int, Means] = {}
    for (k, _), found in zip(wanted, fitted):
        if k not in best or found.cost < best[k].cost:
            best[k] = found
    return {k: _model(df, features, found) for k, found in best.items()}


def _spread(df: DataFrame) -> DataFrame:
    return df.repartition(spread(df.count()))


def fit_kmeans(
    df: DataFrame,
    k: int,
    features: str = "features",
    starts: int = 10,
    seed: int = 42,
    max_iter: int = 300,
    key: str | None = None,
) -> KMeansModel:
    """The best of several seeded starts by within-cluster squared distance.

    A pass over the rows serves all starts. With a ``key`` rows are placed by its draw, so that
    every start draws the same centres whatever files the rows come from; final centres agree to
    within the rounding of sums.
    """
    rows = placed(df.select(key, features), key, seed).select(features) if key else _spread(df.select(features))
    return _fit(rows, features, [k], starts, seed, max_iter)[k]


def sweep_models(
    df: DataFrame, ks: Sequence[int], features: str, starts: int, seed: int, max_iter: int, key: str | None = None, drawn: int = DRAWN
) -> tuple[DataFrame, dict[int, KMeansModel]]:
    """Inertia and silhouette for each k, and the fitted models.

    The silhouette is of squared distances; with a ``key`` column there is also the Euclidean
    one of drawn rows, in ``euclidean``, and its standard error, in ``error``, and the rows
    are placed by it as in :func:`fit_kmeans`.
    """
    held = (placed(df.select(key, features), key, seed) if key else _spread(df.select(features))).persist()
    try:
        rows, found = [], _fit(held, features, ks, starts, seed, max_iter)
        judge = ClusteringEvaluator(featuresCol=features, predictionCol="cluster")
        for k in ks:
            assigned = found[k].transform(held)
            silhouette = judge.evaluate(assigned)
            true = euclidean_silhouette(assigned, key, features, drawn=drawn, seed=seed).head() if key else (None, None)
            rows.append((k, float(found[k].summary.trainingCost), float(silhouette), true[0], true[1]))
    finally:
        held.unpersist()
    table = df.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double, euclidean double, error double")
    return (table if key else table.drop("euclidean", "error")), found


def kmeans_sweep(
    df: DataFrame,
    ks: Sequence[int] = range(2, 11),
    features: str = "features",
    starts: int = 10,
    seed: int = 42,
    max_iter: int = 300,
    key: str | None = None,
) -> DataFrame:
    """Inertia and silhouette (squared Euclidean) for each k; with a ``key`` the Euclidean silhouette too."""
    return sweep_models(df, ks, features, starts, seed, max_iter, key)[0]


def choose_k(sweep: DataFrame, by: str = "silhouette") -> DataFrame:
    """The k with the largest silhouette (``by="euclidean"`` for that of plain distances), the smallest of tied ones."""
    return sweep.orderBy(F.col(by).desc(), "k").limit(1)


def assign_clusters(model: KMeansModel, df: DataFrame) -> DataFrame:
    return model.transform(df)


def cluster_sizes(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    counts = df.groupBy(cluster).agg(F.count("*").alias("rows"))
    total = counts.agg(F.sum("rows")).scalar()
    return counts.withColumn("pct", ratio(F.col("rows") * 100, total))


def label_clusters(profiles: DataFrame, rate: str = "response_rate", hi: float = 15, mid: float = 10) -> DataFrame:
    """Adds the segment label; both limits are strict."""
    label = F.when(F.col(rate) > hi, HIGH).when(F.col(rate) > mid, MODERATE).otherwise(LOW)
    return profiles.withColumn("segment", label)


def profile_clusters(
    df: DataFrame,
    means: Sequence[str],
    modes: Sequence[str],
    flags: Mapping[str, str],
    cluster: str = "cluster",
    label: str = "y",
    positive: str = "yes",
) -> DataFrame:
    """One row per cluster: size, means, most frequent levels, flag shares, response rate, label; one aggregate over the rows.

    ``flags`` maps a column to the level whose share is wanted. Of equally frequent levels the
    smallest is the mode; a cluster keeps a count per level, so ``modes`` are columns of levels.
    """
    types = dict(df.dtypes)
    named = [f"mode_{c}" for c in modes]
    base = df.groupBy(cluster).agg(
        F.count("*").alias("rows"),
        *[F.avg(number(c, types[c])).alias(f"mean_{c}") for c in means],
        *[(F.avg(indicator(F.col(c) == v)) * 100).alias(f"pct_{c}") for c, v in flags.items()],
        (F.avg(indicator(F.col(label) == positive)) * 100).alias("response_rate"),
        *[F.mode(F.col(c).cast("string"), True).alias(f"mode_{c}") for c in modes],
    )
    # A row per cluster.
    share = ratio(F.col("rows") * 100, F.sum("rows").over(W.partitionBy())).alias("pct")
    return label_clusters(base.select(*[c for c in base.columns if c not in named], share, *named))


def cluster_vs_overall(
    df: DataFrame, cluster: str = "cluster", label: str = "y", positive: str = "yes"
) -> tuple[DataFrame, DataFrame]:
    """Rate per cluster beside the overall rate, and the best and worst cluster."""
    hit = indicator(F.col(label) == positive)
    rates = df.groupBy(F.col(cluster).alias("level")).agg(F.count("*").alias("rows"), (F.avg(hit) * 100).alias("rate"))
    overall = df.agg(F.avg(hit) * 100).scalar()
    return rates.withColumn("overall", overall), best_worst(rates)
