"""Classifiers on MLlib, scoring, importances, and the run loop.

Encoded categories are plain numbers that trees split by order, unless ``nominal`` names
them with their number of codes: then trees split them by sets of codes. With a ``key``
the rows are placed by its draw first, and the same rows give the same forest however
their files are laid out; boosted trees agree to within the rounding of sums.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campaignlens.functions.draws import draw_unit
from campaignlens.operators import margins
from campaignlens.operators.evaluate import binary_metrics, roc_auc
from campaignlens.operators.neighbors import knn_classify
from campaignlens.operators.passes import Blocks
from campaignlens.operators.prep import assemble, placed
from campaignlens.operators.running import running
from campaignlens.operators.trees import fit_forest
from campaignlens.session import written

LABEL = "label"
MAX_LEVELS = 4096  # codes of a nominal feature


@dataclass
class Fitted:
    """A fitted classifier: what it was trained on and how to score a frame with it."""

    name: str
    features: list[str]
    scorer: Callable[[DataFrame], DataFrame]
    model: Model | None = None
    seconds: float = 0.0
    params: dict[str, object] = field(default_factory=dict)

    def score(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction`` (0 or 1) and ``score`` (probability of class 1)."""
        return self.scorer(df)


def _probability_scorer(model: Model, features: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    def run(df: DataFrame) -> DataFrame:
        out = model.transform(assemble(df, features))
        return out.select(
            *[F.col(c) for c in df.columns],
            F.col("prediction").cast("int").alias("prediction"),
            vector_to_array("probability")[1].alias("score"),
        )

    return run


def _finish(
    name: str,
    estimator,
    train: DataFrame,
    features: Sequence[str],
    params: dict,
    nominal: Mapping[str, int] | None = None,
    key: str | None = None,
) -> Fitted:
    start = time.time()
    rows = assemble(train, features, nominal=nominal).select(*([key] if key else []), "features", *_extra(estimator))
    model = estimator.fit(placed(rows, key).drop(key) if key else rows)
    return Fitted(name, list(features), _probability_scorer(model, features), model, time.time() - start, params)


def _extra(estimator) -> list[str]:
    weighted = estimator.hasParam("weightCol") and estimator.isSet("weightCol")
    return [estimator.getLabelCol(), *([estimator.getWeightCol()] if weighted else [])]


def train_logistic(
    train: DataFrame, features: Sequence[str], label: str = LABEL, max_iter: int = 1000, weight: str | None = None
) -> Fitted:
    """L2 penalty with unit inverse strength on the summed loss, free intercept."""
    rows = train.count()
    estimator = LogisticRegression(
        labelCol=label, maxIter=max_iter, regParam=1.0 / max(rows, 1), elasticNetParam=0.0, standardization=False
    )
    if weight:
        estimator = estimator.setWeightCol(weight)
    return _finish("Logistic Regression", estimator, train, features, {"max_iter": max_iter})


def train_forest(
    train: DataFrame,
    features: Sequence[str],
    label: str = LABEL,
    trees: int = 100,
    depth: int = 10,
    seed: int = 42,
    bins: int = 64,
    nominal: Mapping[str, int] | None = None,
    key: str | None = None,
) -> Fitted:
    """Bagged trees on a root of the features each; a nominal feature with more codes than ``bins`` raises the bins.

    Labels of 0 and 1 are fitted by :mod:`campaignlens.operators.trees`, others by MLlib.
    """
    start = time.time()
    bins = _bins(bins, features, nominal)
    estimator = RandomForestClassifier(
        labelCol=label, numTrees=trees, maxDepth=depth, seed=seed, maxBins=bins, featureSubsetStrategy="sqrt"
    )
    params = {"n_estimators": trees, "max_depth": depth, "random_state": seed}
    two = F.bool_and(F.coalesce(F.col(label).cast("double").isin(0.0, 1.0), F.lit(False)))
    if train.agg(two & (F.max(F.col(label).cast("double")) == 1)).head()[0] is not True:
        return _finish("Random Forest", estimator, train, features, params, nominal, key)
    rows = assemble(train, features, nominal=nominal).select(*([key] if key else []), vector_to_array("features").alias("features"), label)
    levels = {i: nominal[c] for i, c in enumerate(features) if c in (nominal or {})}
    model = fit_forest(placed(rows, key) if key else rows, "features", estimator, len(features), levels)
    return Fitted("Random Forest", list(features), _probability_scorer(model, features), model, time.time() - start, params)


def train_boosting(
    train: DataFrame,
    features: Sequence[str],
    label: str = LABEL,
    rounds: int = 100,
    depth: int = 5,
    seed: int = 42,
    step: float = 0.1,
    bins: int = 32,
    nominal: Mapping[str, int] | None = None,
    key: str | None = None,
) -> Fitted:
    """Boosted trees. Checkpoints every tenth round when the session has a checkpoint folder."""
    bins = _bins(bins, features, nominal)
    estimator = GBTClassifier(labelCol=label, maxIter=rounds, maxDepth=depth, seed=seed, stepSize=step, maxBins=bins)
    params = {"n_estimators": rounds, "max_depth": depth, "random_state": seed}
    return _finish("Gradient Boosting", estimator, train, features, params, nominal, key)


def _bins(bins: int, features: Sequence[str], nominal: Mapping[str, int] | None) -> int:
    """Bins that hold every code of the nominal features; statistics per node grow with them."""
    most = max([n for c, n in (nominal or {}).items() if c in features], default=0)
    if most > MAX_LEVELS:
        raise ValueError(f"a nominal feature has {most} levels, at most {MAX_LEVELS} are split by sets")
    return max(bins, most)


def train_neighbors(train: DataFrame, features: Sequence[str], key: str, label: str = LABEL, k: int = 5) -> Fitted:
    """k nearest neighbours; training keeps the rows, in the shared folder, and the search happens at scoring time."""
    start = time.time()
    slim = written(train.select(key, F.array(*[F.col(c).cast("double") for c in features]).alias("_v"), label), "neighbours")

    def run(df: DataFrame) -> DataFrame:
        asked = df.select(key, F.array(*[F.col(c).cast("double") for c in features]).alias("_v"))
        votes = knn_classify(slim, asked, key, "_v", label, k)
        return df.join(votes.select(key, F.col("prediction").cast("int").alias("prediction"), "score"), key)

    return Fitted("K-Nearest Neighbors", list(features), run, None, time.time() - start, {"n_neighbors": k})


def train_rbf_svm(
    train: DataFrame,
    features: Sequence[str],
    key: str,
    label: str = LABEL,
    dims: int = 256,
    folds: int = 3,
    seed: int = 42,
    max_iter: int = 100,
    tolerance: float = 1e-3,
) -> Fitted:
    """An approximation of the RBF support vector classifier.

    Random Fourier features, a linear SVM on them, and a logistic fit of the
    margins of held-out folds for the probability. The raw rows are kept and lifted
    in each pass, which serves the fits of all folds and of all rows at once.
    """
    start = time.time()
    values = [F.col(c).cast("double") for c in features]
    d = len(values)
    mean = F.avg(sum(values, F.lit(0.0)) / d)
    square = F.avg(sum((v * v for v in values), F.lit(0.0)) / d)
    m, s, rows = train.agg(mean, square, F.count("*")).head()
    spread = s - m * m
    gamma = 1.0 / (d * spread) if spread > 0 else 1.0 / d
    waves = margins.Waves(dims, d, gamma, seed)
    inputs = F.array(*values)
    # A row without a key is in no fold.
    fold = F.coalesce(F.floor(draw_unit(key, seed + 1) * folds).cast("int"), F.lit(-1))
    blocks = Blocks(train.select(F.array(*values, F.col(label).cast("double"), fold.cast("double")).alias("x")), "x")
    try:
        *partial, whole = margins.fit_many(blocks, waves, [*range(folds), None], 1.0 / max(rows, 1), max_iter, tolerance)
    finally:
        blocks.drop()

    def with_margin(df: DataFrame, machines: Sequence[margins.Margin], number: Column) -> DataFrame:
        return df.withColumn("_margin", margins.margin_of(waves, machines)(inputs, number)).withColumn("_m", array_to_vector(F.array("_margin")))

    held_out = with_margin(train.filter(fold >= 0), partial, fold).select(label, "_m")
    platt = LogisticRegression(labelCol=label, featuresCol="_m", predictionCol="_p").fit(held_out)

    def run(df: DataFrame) -> DataFrame:
        return platt.transform(with_margin(df, [whole], F.lit(0))).select(
            *[F.col(c) for c in df.columns],
            (F.col("_margin") > 0).cast("int").alias("prediction"),
            vector_to_array("probability")[1].alias("score"),
        )

    params = {"kernel": "rbf (random Fourier features)", "dims": dims, "gamma": gamma}
    return Fitted("Support Vector Machine", list(features), run, None, time.time() - start, params)


# Evaluation loop


def evaluate(fitted: Fitted, test: DataFrame, label: str = LABEL) -> dict[str, float]:
    """Metrics of one model on the test rows, scored once."""
    scored = fitted.score(test).select(F.col(label).alias("label"), "prediction", "score").persist()
    try:
        out = dict(binary_metrics(scored).head().asDict())
        out["roc_auc"] = roc_auc(scored).head()["roc_auc"] or 0.0
    finally:
        scored.unpersist()
    return out


METRICS = "position int, model string, accuracy double, precision double, recall double, f1 double, roc_auc double, training_time_s double"


def train_all(
    trainers: Mapping[str, Callable[[DataFrame], Fitted]], train: DataFrame, test: DataFrame, label: str = LABEL
) -> tuple[DataFrame, dict[str, Fitted]]:
    """Fits and evaluates every model on one cached train set; a metrics row per model."""
    train = train.persist()
    try:
        rows, fitted = [], {}
        for position, (name, fit) in enumerate(trainers.items()):
            fitted[name] = fit(train)
            m = evaluate(fitted[name], test, label)
            rows.append(
                (position, name, m["accuracy"], m["precision"], m["recall"], m["f1"], m["roc_auc"], fitted[name].seconds)
            )
    finally:
        train.unpersist()
    return train.sparkSession.createDataFrame(rows, METRICS), fitted


# Interpretation


def _named(df: DataFrame, names: Sequence[str], values: Sequence[float], column: str) -> DataFrame:
    rows = [(i, n, float(v)) for i, (n, v) in enumerate(zip(names, values))]
    return df.sparkSession.createDataFrame(rows, f"position int, feature string, {column} double")


def feature_importance(fitted: Fitted, df: DataFrame) -> DataFrame:
    """Importance per feature of a tree model, largest first."""
    table = _named(df, fitted.features, fitted.model.featureImportances.toArray(), "importance")
    return table.orderBy(F.col("importance").desc(), "feature")


def coefficients(fitted: Fitted, df: DataFrame) -> DataFrame:
    """Coefficient per feature of a linear model, largest absolute value first."""
    table = _named(df, fitted.features, fitted.model.coefficients.toArray(), "coefficient")
    return table.orderBy(F.abs("coefficient").desc(), "feature")


def importance_or_coefficients(fitted: Fitted, df: DataFrame) -> DataFrame:
    """Whichever the model offers as ``(feature, value)``; no rows if it offers neither."""
    if hasattr(fitted.model, "featureImportances"):
        return feature_importance(fitted, df).select("feature", F.col("importance").alias("value"))
    if hasattr(fitted.model, "coefficients"):
        return coefficients(fitted, df).select("feature", F.col("coefficient").alias("value"))
    return df.sparkSession.createDataFrame([], "feature string, value double")


def permutation_importance(
    fitted: Fitted,
    df: DataFrame,
    key: str,
    label: str = LABEL,
    seed: int = 42,
    parts: int | None = None,
    parallelism: int = 4,
) -> DataFrame:
    """Loss of ROC AUC when one feature at a time is exchanged between rows.

    Rows are paired by their position in two independent draw orders, once for
    all features.
    """

    def placed(name: str, offset: int) -> DataFrame:
        drawn = df.withColumn("_u", draw_unit(key, seed + offset))
        return running(drawn, "_u", {}, key=key, seed=seed + offset, parts=parts).select(
            F.col("position").alias("_at"), *[F.col(c).alias(f"{name}{c}") for c in (*fitted.features, key, label)]
        )

    paired = placed("", 1).join(placed("_other_", 2), "_at").persist()
    try:
        columns = [key, label, *fitted.features]

        def auc(shuffled: str | None) -> float:
            rows = paired.select(*[F.col(f"_other_{c}" if c == shuffled else c).alias(c) for c in columns])
            return float(roc_auc(fitted.score(rows), label).head()["roc_auc"])

        base = auc(None)
        with ThreadPool(parallelism) as pool:
            found = pool.map(inheritable_thread_target(df.sparkSession)(auc), fitted.features)
    finally:
        paired.unpersist()
    rows = [(f, base, base - a) for f, a in zip(fitted.features, found)]
    return df.sparkSession.createDataFrame(rows, "feature string, roc_auc double, loss double")
