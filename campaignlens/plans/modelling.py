"""From contact rows to a compared set of classifiers."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from campaignlens.functions.scalars import yes_no
from campaignlens.operators import models, prep
from campaignlens.operators.evaluate import select_best
from campaignlens.session import written
from campaignlens.sources.sinks import run_rows, save_model, write_runs


@dataclass
class Prepared:
    """Train and test rows, raw and scaled, with what was fitted on the way."""

    train: DataFrame
    test: DataFrame
    train_scaled: DataFrame
    test_scaled: DataFrame
    features: list[str]
    dictionary: DataFrame


def prepare(
    df: DataFrame,
    key: str,
    numeric: Sequence[str],
    categorical: Sequence[str],
    label: str = "y",
    test: float = 0.2,
    seed: int = 42,
    balance: str = "all",
) -> Prepared:
    """Encode, balance, split and scale.

    ``balance='all'`` undersamples before the split, so the test rows are balanced
    too; ``'train'`` leaves the test rows at their natural class shares; ``'none'``
    keeps every row. Rows without a label are left out.
    """
    df = written(df.select(key, *numeric, *categorical, label), "contacts")
    dictionary = prep.fit_label_dictionary(df, categorical)
    coded = prep.encode(df, dictionary, categorical)
    # Balancing, splitting, scaling and every fit read these rows again.
    coded = coded.withColumn("label", yes_no(label)).drop(label)
    coded = written(coded.filter(F.col("label").isNotNull()), "coded")
    if balance == "all":
        coded = prep.undersample(coded, "label", key, seed)
    # The rows of both parts lie in as many files as a fit has partitions, so that fits use every core.
    parts = prep.stratified_split(coded, "label", key, test, seed + 1)
    parts = written(prep.placed(parts, key, seed + 2), "parts")
    train = parts.filter(F.col("split") == "train").drop("split")
    held_out = parts.filter(F.col("split") == "test").drop("split")
    if balance == "train":
        train = prep.undersample(train, "label", key, seed)
    features = [*numeric, *categorical]
    train_scaled, test_scaled = prep.standardize(train, [held_out], features)
    return Prepared(train, held_out, train_scaled, test_scaled, features, dictionary)


def five_models(
    features: Sequence[str], key: str, seed: int = 42, trees: int = 100, rounds: int = 100
) -> dict[str, Callable[[DataFrame], models.Fitted]]:
    """The compared classifiers with their settings."""
    return {
        "Logistic Regression": lambda t: models.train_logistic(t, features),
        "Random Forest": lambda t: models.train_forest(t, features, trees=trees, depth=15, seed=seed, key=key),
        "Gradient Boosting": lambda t: models.train_boosting(t, features, rounds=rounds, depth=5, seed=seed, key=key),
        "K-Nearest Neighbors": lambda t: models.train_neighbors(t, features, key),
        "Support Vector Machine": lambda t: models.train_rbf_svm(t, features, key, seed=seed),
    }


def bake_off(
    prepared: Prepared, key: str, trainers: Mapping[str, Callable[[DataFrame], models.Fitted]] | None = None
) -> tuple[DataFrame, dict[str, models.Fitted]]:
    """All models on the scaled rows: the metrics table and the fitted models."""
    trainers = trainers or five_models(prepared.features, key)
    return models.train_all(trainers, prepared.train_scaled, prepared.test_scaled)


def winner(
    prepared: Prepared,
    key: str,
    log: str,
    trainers: Mapping[str, Callable[[DataFrame], models.Fitted]] | None = None,
    experiment: str = "bake-off",
    metric: str = "f1",
) -> tuple[Row, DataFrame]:
    """All models trained and logged to the folder ``log``; the best run's metrics and its scored test rows.

    A run is logged with its model's settings, the sizes of both parts, its metrics and,
    where the model can be written, the path of its file. The scored rows feed confusion,
    report, curves and business metrics.
    """
    spark = prepared.train.sparkSession
    metrics, fitted = bake_off(prepared, key, trainers)
    sizes = {"train_rows": prepared.train.count(), "test_rows": prepared.test.count()}
    for row in metrics.collect():  # one row per model
        model = fitted[row["model"]]
        params = {"model_type": row["model"], **model.params, **sizes, "scaled": True}
        if model.model is not None:
            params["model_path"] = f"{log}-models/{row['model'].replace(' ', '-')}"
            save_model(model.model, params["model_path"])
        values = {c: row[c] for c in metrics.columns if c not in ("position", "model")}
        write_runs(run_rows(spark, experiment, row["model"], params, values), log)
    best = select_best(metrics, metric).head()
    scored = fitted[best["model"]].score(prepared.test_scaled).select(key, "label", "prediction", "score")
    return best, written(scored, "winner")


def scaled_runs(
    prepared: Prepared, trees: int = 100, depth: int = 10
) -> tuple[DataFrame, dict[tuple[str, bool], models.Fitted]]:
    """Forest and logistic regression on raw and on scaled rows: four metric rows, and the models by family and scaling."""
    fits = {
        "Random Forest": lambda t: models.train_forest(t, prepared.features, trees=trees, depth=depth),
        "Logistic Regression": lambda t: models.train_logistic(t, prepared.features),
    }
    raw, plain = models.train_all(fits, prepared.train, prepared.test)
    scaled, changed = models.train_all(fits, prepared.train_scaled, prepared.test_scaled)
    table = raw.withColumn("scaled", F.lit(False)).unionByName(
        scaled.withColumn("scaled", F.lit(True)).withColumn("position", F.col("position") + 2)
    ).withColumnRenamed("model", "family")
    fitted = {(name, s): model for s, found in ((False, plain), (True, changed)) for name, model in found.items()}
    return table, fitted


def scaled_vs_unscaled(prepared: Prepared, trees: int = 100, depth: int = 10) -> DataFrame:
    """The metric rows of :func:`scaled_runs`."""
    return scaled_runs(prepared, trees, depth)[0]
