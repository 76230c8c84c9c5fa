from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from campaignlens.operators import evaluate as E


def frame(spark, labels, scores, threshold=0.5):
    pdf = pd.DataFrame({"label": labels, "score": np.asarray(scores, dtype=float)})
    pdf["prediction"] = (pdf["score"] >= threshold).astype(int)
    return spark.createDataFrame(pdf)


def brute_auc(labels, scores):
    p = [s for s, y in zip(scores, labels) if y == 1]
    n = [s for s, y in zip(scores, labels) if y == 0]
    return float(np.mean([[1.0 if a > b else 0.5 if a == b else 0.0 for b in n] for a in p]))


@pytest.mark.parametrize("digits", [1, 3, 15])
def test_auc_matches_brute_force_and_the_evaluator(spark, digits):
    rng = np.random.default_rng(digits)
    labels = rng.integers(0, 2, 300)
    scores = (rng.random(300) + 0.3 * labels).round(digits)
    df = frame(spark, labels, scores)
    got = E.roc_auc(df, parts=5).head()[0]
    assert got == pytest.approx(brute_auc(labels, scores))
    judge = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0)
    assert got == pytest.approx(judge.evaluate(df))


def test_auc_of_equal_scores_and_of_one_class(spark):
    assert E.roc_auc(frame(spark, [0, 1, 1], [0.4] * 3)).head()[0] == 0.5
    assert E.roc_auc(frame(spark, [1, 1], [0.4, 0.5])).head()[0] is None


def test_metrics_are_zero_where_undefined(spark):
    row = E.binary_metrics(frame(spark, [1, 1], [0.1, 0.2])).head()
    assert tuple(row) == (0.0, 0.0, 0.0, 0.0)
    row = E.binary_metrics(frame(spark, [0, 0], [0.1, 0.2])).head()
    assert tuple(row) == (1.0, 0.0, 0.0, 0.0)


def test_curves(spark):
    df = frame(spark, [0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8])
    roc = sorted((r["fpr"], r["tpr"]) for r in E.roc_curve(df).collect())
    assert roc == [(0.0, 0.0), (0.0, 0.5), (0.5, 0.5), (0.5, 1.0), (1.0, 1.0)]
    pr = {r["threshold"]: (r["precision"], r["recall"]) for r in E.pr_curve(df).collect()}
    assert pr[None] == (1.0, 0.0) and pr[0.35] == (pytest.approx(2 / 3), 1.0) and pr[0.8] == (1.0, 0.5)
    assert E.pr_auc(df).head()[0] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)


def test_threshold_of_least_cost(spark):
    best = E.best_threshold(frame(spark, [0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8]), 1, 5).head()
    assert (best["threshold"], best["cost"], best["fp"], best["fn"]) == (0.35, 1.0, 1, 0)


def test_report_rows(spark):
    got = {r["name"]: r for r in E.classification_report(frame(spark, [0, 0, 0, 1], [0.1, 0.2, 0.9, 0.9])).collect()}
    assert got["Subscribe"]["precision"] == 0.5 and got["Subscribe"]["recall"] == 1.0
    assert got["accuracy"]["f1"] == 0.75 and got["accuracy"]["precision"] is None
    assert got["weighted avg"]["recall"] == pytest.approx(0.75) and got["macro avg"]["support"] == 4


METRICS = "model string, position int, precision double, recall double, f1 double"


def test_best_model_ties_go_to_the_declared_order(spark):
    df = spark.createDataFrame([("a", 1, 0.5, 0.5, 0.7), ("b", 0, 0.4, 0.4, 0.7), ("c", 2, 0.4, 0.4, 0.1)], METRICS)
    assert E.select_best(df).head()["model"] == "b"
    parts = [df.filter(F.col("model") == m) for m in "abc"]
    assert [r["model"] for r in E.compare_models(parts).collect()] == ["a", "b", "c"]


def test_scaling_improvement(spark):
    rows = [("lr", False, 0.5, 0.8), ("lr", True, 0.6, 0.4)]
    df = spark.createDataFrame(rows, "family string, scaled boolean, precision double, recall double")
    row = E.scaling_improvement(df).head()
    assert row["precision_change_pct"] == pytest.approx(20.0) and row["recall_change_pct"] == pytest.approx(-50.0)
