"""Evaluation of scored rows: a 0/1 ``label``, a ``prediction`` and a ``score``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campaignlens.functions.scalars import or_zero, percent, ratio, relative_change, safe_metric
from campaignlens.operators.running import running
from campaignlens.session import written


def _cell(label: str, prediction: str, actual: int, predicted: int) -> Column:
    return F.count(F.when((F.col(label) == actual) & (F.col(prediction) == predicted), 1))


def confusion_counts(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: tn, fp, fn, tp."""
    return df.agg(
        _cell(label, prediction, 0, 0).alias("tn"),
        _cell(label, prediction, 0, 1).alias("fp"),
        _cell(label, prediction, 1, 0).alias("fn"),
        _cell(label, prediction, 1, 1).alias("tp"),
    )


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Four rows: actual and predicted class, rows, per cent of all."""
    counts = confusion_counts(df, label, prediction)
    cells = [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]
    total = sum((F.col(c) for *_, c in cells), F.lit(0))
    rows = [
        F.struct(
            F.lit(a).cast("long").alias("actual"),
            F.lit(p).cast("long").alias("predicted"),
            F.lit(c).alias("cell"),
            F.col(c).alias("rows"),
            percent(F.col(c), total).alias("pct"),
        )
        for a, p, c in cells
    ]
    return counts.select(F.inline(F.array(*rows)))


def _precision(tp: Column, fp: Column) -> Column:
    return safe_metric(tp, tp + fp)


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return safe_metric(tp * 2, tp * 2 + fp + fn)


def metrics_from_counts(counts: DataFrame) -> DataFrame:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counts.select(
        safe_metric(tp + tn, tn + fp + fn + tp).alias("accuracy"),
        _precision(tp, fp).alias("precision"),
        _precision(tp, fn).alias("recall"),
        _f1(tp, fp, fn).alias("f1"),
    )


def binary_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy, and precision, recall and F1 of class 1; 0 where undefined."""
    return metrics_from_counts(confusion_counts(df, label, prediction))


def classification_report(
    df: DataFrame,
    names: Sequence[str] = ("No Subscribe", "Subscribe"),
    label: str = "label",
    prediction: str = "prediction",
) -> DataFrame:
    """Per class, accuracy, and plain and support-weighted averages."""
    counts = confusion_counts(df, label, prediction)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    scored = counts.select(
        "*",
        _precision(tn, fn).alias("p0"),
        _precision(tn, fp).alias("r0"),
        _f1(tn, fn, fp).alias("f0"),
        (tn + fp).alias("s0"),
        _precision(tp, fp).alias("p1"),
        _precision(tp, fn).alias("r1"),
        _f1(tp, fp, fn).alias("f1"),
        (tp + fn).alias("s1"),
    )
    total = F.col("s0") + F.col("s1")

    def row(name: str, p: Column, r: Column, f: Column, s: Column) -> Column:
        return F.struct(
            F.lit(name).alias("name"),
            p.cast("double").alias("precision"),
            r.cast("double").alias("recall"),
            f.cast("double").alias("f1"),
            s.alias("support"),
        )

    def mean(x: str) -> Column:
        return (F.col(f"{x}0") + F.col(f"{x}1")) / 2

    def weighted(x: str) -> Column:
        return safe_metric(F.col(f"{x}0") * F.col("s0") + F.col(f"{x}1") * F.col("s1"), total)

    none = F.lit(None)
    rows = [
        row(names[0], F.col("p0"), F.col("r0"), F.col("f0"), F.col("s0")),
        row(names[1], F.col("p1"), F.col("r1"), F.col("f1"), F.col("s1")),
        row("accuracy", none, none, safe_metric(tn + tp, total), total),
        row("macro avg", mean("p"), mean("r"), mean("f"), total),
        row("weighted avg", weighted("p"), weighted("r"), weighted("f"), total),
    ]
    return scored.select(F.inline(F.array(*rows)))


def business_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Recall, precision and specificity in per cent, under their campaign names."""
    counts = confusion_counts(df, label, prediction)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counts.select(
        or_zero(percent(tp, tp + fn)).alias("conversion_accuracy"),
        or_zero(percent(tp, tp + fp)).alias("campaign_efficiency"),
        or_zero(percent(tn, tn + fp)).alias("cost_savings"),
        or_zero(percent(tn, tn + fp)).alias("specificity"),
        (tp + fn).alias("actual_positive"),
        (tp + fp).alias("targeted"),
    )


# Threshold curves


def score_table(df: DataFrame, label: str = "label", score: str = "score", digits: int | None = None) -> DataFrame:
    """Positive and negative rows per distinct score, optionally rounded first."""
    s = F.col(score).cast("double")
    s = s if digits is None else F.round(s, digits)
    return (
        df.select(s.alias("score"), F.col(label).alias("label"))
        .filter(F.col("score").isNotNull() & F.col("label").isNotNull())
        .groupBy("score")
        .agg(
            F.count(F.when(F.col("label") == 1, 1)).alias("pos"),
            F.count(F.when(F.col("label") == 0, 1)).alias("neg"),
        )
    )


def _collapsed(df: DataFrame, label: str, score: str, digits: int | None) -> DataFrame:
    """The score table worked out once: the rows behind it may come from a model."""
    return written(score_table(df, label, score, digits), "score-table")


def _totals(table: DataFrame) -> Column:
    return table.agg(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n"))).scalar()


def threshold_table(
    df: DataFrame, label: str = "label", score: str = "score", digits: int | None = None, parts: int | None = None
) -> DataFrame:
    """Per distinct score as threshold: tp, fp, fn, tn when rows at or above it are targeted."""
    table = _collapsed(df, label, score, digits)
    out = running(table, "score", {"tp": F.col("pos"), "fp": F.col("neg")}, descending=True, parts=parts)
    out = out.withColumn("_t", _totals(table))
    return out.select(
        F.col("score").alias("threshold"),
        "tp",
        "fp",
        (F.col("_t.p") - F.col("tp")).alias("fn"),
        (F.col("_t.n") - F.col("fp")).alias("tn"),
        "pos",
        "neg",
    )


def roc_curve(df: DataFrame, label: str = "label", score: str = "score", digits: int | None = None) -> DataFrame:
    """False and true positive rate per threshold, and the origin with an infinite threshold."""
    points = threshold_table(df, label, score, digits).select(
        "threshold",
        or_zero(ratio(F.col("fp"), F.col("fp") + F.col("tn"))).alias("fpr"),
        or_zero(ratio(F.col("tp"), F.col("tp") + F.col("fn"))).alias("tpr"),
    )
    origin = df.sparkSession.createDataFrame([(float("inf"), 0.0, 0.0)], points.schema)
    return points.unionByName(origin)


def roc_auc(
    df: DataFrame, label: str = "label", score: str = "score", digits: int | None = None, parts: int | None = None
) -> DataFrame:
    """Exact area under the ROC curve, ties counted half; null when a class is absent."""
    table = _collapsed(df, label, score, digits)
    below = running(table, "score", {"upto": F.col("neg")}, parts=parts)
    wins = F.sum(F.col("pos") * (F.col("upto") - F.col("neg") + F.col("neg") / 2))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return below.agg(ratio(wins, pairs).alias("roc_auc"))


def pr_curve(df: DataFrame, label: str = "label", score: str = "score", digits: int | None = None) -> DataFrame:
    """Precision and recall per threshold, and the closing point (1, 0) without threshold."""
    points = threshold_table(df, label, score, digits).select(
        "threshold",
        _precision(F.col("tp"), F.col("fp")).alias("precision"),
        _precision(F.col("tp"), F.col("fn")).alias("recall"),
    )
    closing = df.sparkSession.createDataFrame([(None, 1.0, 0.0)], points.schema)
    return points.unionByName(closing)


def pr_auc(df: DataFrame, label: str = "label", score: str = "score", digits: int | None = None) -> DataFrame:
    """Average precision: precision at each threshold weighted by the recall it adds."""
    points = threshold_table(df, label, score, digits)
    gain = F.sum(F.col("pos") * _precision(F.col("tp"), F.col("fp")))
    return points.agg(ratio(gain, F.sum("pos")).alias("pr_auc"))


def best_threshold(
    df: DataFrame, cost_fp: float = 1.0, cost_fn: float = 5.0, label: str = "label", score: str = "score"
) -> DataFrame:
    """The threshold of least cost, the highest of equal ones, with its cost and counts."""
    points = threshold_table(df, label, score)
    cost = F.col("fp") * F.lit(float(cost_fp)) + F.col("fn") * F.lit(float(cost_fn))
    best = F.min(F.struct(cost.alias("cost"), (-F.col("threshold")).alias("t"), "tp", "fp", "fn", "tn"))
    return points.agg(best.alias("b")).select(
        (-F.col("b.t")).alias("threshold"), "b.cost", "b.tp", "b.fp", "b.fn", "b.tn"
    )


# Model tables


def compare_models(metrics: Sequence[DataFrame], by: str = "f1", descending: bool = True) -> DataFrame:
    """The metric rows of several runs as one sorted table."""
    out = metrics[0]
    for m in metrics[1:]:
        out = out.unionByName(m)
    return out.orderBy(F.col(by).desc() if descending else F.col(by).asc(), "model")


def select_best(metrics: DataFrame, metric: str = "f1", order: str = "position") -> DataFrame:
    """The run with the largest metric; the first in the declared order wins a tie."""
    return metrics.orderBy(F.col(metric).desc_nulls_last(), order).limit(1)


def scaling_improvement(metrics: DataFrame, family: str = "family", scaled: str = "scaled") -> DataFrame:
    """Relative change of precision and recall from the raw to the scaled run of each model."""
    value = {
        (m, s): F.max(F.when(F.col(scaled) == s, F.col(m))) for m in ("precision", "recall") for s in (True, False)
    }
    return metrics.groupBy(family).agg(
        *[relative_change(value[m, True], value[m, False]).alias(f"{m}_change_pct") for m in ("precision", "recall")]
    )
