"""Evaluation measures on a fixed score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from campaignlens.operators import evaluate
from campaignlens.plans.catalog.common import CONTACTS, neat, on_scored, query
from campaignlens.plans.contacts import contacts
from campaignlens.sources.readers import read_table

COUNTS = """, m AS (SELECT count(*) FILTER (label = 0 AND prediction = 0)::DOUBLE AS tn,
  count(*) FILTER (label = 0 AND prediction = 1)::DOUBLE AS fp,
  count(*) FILTER (label = 1 AND prediction = 0)::DOUBLE AS fn,
  count(*) FILTER (label = 1 AND prediction = 1)::DOUBLE AS tp FROM scored)
"""


@on_scored(
    "confusion",
    COUNTS
    + " UNION ALL ".join(
        f"SELECT {a}::BIGINT AS actual, {p}::BIGINT AS predicted, '{c}' AS cell, {c}::BIGINT AS n, "
        f"round(100 * {c} / (tn + fp + fn + tp), 6) AS pct FROM m"
        for a, p, c in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))
    ),
)
def confusion(df: DataFrame) -> DataFrame:
    return neat(evaluate.confusion(df).withColumnRenamed("rows", "n"))


@on_scored(
    "binary_metrics",
    COUNTS
    + """SELECT round((tp + tn) / (tn + fp + fn + tp), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision,
  round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM m""",
)
def binary_metrics(df: DataFrame) -> DataFrame:
    return neat(evaluate.binary_metrics(df))


@on_scored(
    "classification_report",
    COUNTS
    + """, c AS (SELECT *, tn / (tn + fn) AS p0, tn / (tn + fp) AS r0, 2 * tn / (2 * tn + fn + fp) AS f0, tn + fp AS s0,
    tp / (tp + fp) AS p1, tp / (tp + fn) AS r1, 2 * tp / (2 * tp + fp + fn) AS f1, tp + fn AS s1 FROM m),
  r AS (SELECT 'No Subscribe' AS name, p0 AS precision, r0 AS recall, f0 AS f, s0 AS support FROM c
  UNION ALL SELECT 'Subscribe', p1, r1, f1, s1 FROM c
  UNION ALL SELECT 'accuracy', NULL, NULL, (tn + tp) / (s0 + s1), s0 + s1 FROM c
  UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s0 + s1 FROM c
  UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / (s0 + s1), (r0 * s0 + r1 * s1) / (s0 + s1),
    (f0 * s0 + f1 * s1) / (s0 + s1), s0 + s1 FROM c)
  SELECT name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f, 6) AS f1,
    support::BIGINT AS support FROM r""",
)
def classification_report(df: DataFrame) -> DataFrame:
    return neat(evaluate.classification_report(df))


@on_scored(
    "business_metrics",
    COUNTS
    + """SELECT round(100 * tp / (tp + fn), 6) AS conversion_accuracy, round(100 * tp / (tp + fp), 6) AS campaign_efficiency,
  round(100 * tn / (tn + fp), 6) AS cost_savings, round(100 * tn / (tn + fp), 6) AS specificity,
  (tp + fn)::BIGINT AS actual_positive, (tp + fp)::BIGINT AS targeted FROM m""",
)
def business_metrics(df: DataFrame) -> DataFrame:
    return neat(evaluate.business_metrics(df))


POINTS = """, s AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM scored GROUP BY score),
  k AS (SELECT score, pos, neg, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp,
    CAST(sum(pos) OVER () AS BIGINT) AS p, CAST(sum(neg) OVER () AS BIGINT) AS n FROM s WINDOW w AS (ORDER BY score DESC))
"""


@on_scored(
    "threshold_table",
    POINTS + "SELECT score AS threshold, tp, fp, p - tp AS fn, n - fp AS tn, pos, neg FROM k",
)
def threshold_table(df: DataFrame) -> DataFrame:
    return evaluate.threshold_table(df)


@on_scored(
    "roc_curve",
    POINTS
    + """SELECT score AS threshold, round(fp::DOUBLE / n, 6) AS fpr, round(tp::DOUBLE / p, 6) AS tpr FROM k
  UNION ALL SELECT 'inf'::DOUBLE, 0, 0""",
)
def roc_curve(df: DataFrame) -> DataFrame:
    points = evaluate.roc_curve(df)
    return points.select("threshold", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


AUC = """SELECT round(sum(pos * (n - fp + neg / 2.0::DOUBLE)) / (max(p)::DOUBLE * max(n)), 6) AS roc_auc FROM k"""


@on_scored("roc_auc", POINTS + AUC)
def roc_auc(df: DataFrame) -> DataFrame:
    return neat(evaluate.roc_auc(df))


@on_scored(
    "pr_curve",
    POINTS
    + """SELECT score AS threshold, round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / p, 6) AS recall FROM k
  UNION ALL SELECT NULL, 1, 0""",
)
def pr_curve(df: DataFrame) -> DataFrame:
    return neat(evaluate.pr_curve(df))


@on_scored("pr_auc", POINTS + "SELECT round(sum(pos * (tp::DOUBLE / (tp + fp))) / max(p), 6) AS pr_auc FROM k")
def pr_auc(df: DataFrame) -> DataFrame:
    return neat(evaluate.pr_auc(df))


@on_scored(
    "best_threshold",
    POINTS
    + """SELECT score AS threshold, fp * 1.0::DOUBLE + (p - tp) * 4.0::DOUBLE AS cost, tp, fp, p - tp AS fn, n - fp AS tn FROM k
  ORDER BY cost, threshold DESC LIMIT 1""",
)
def best_threshold(df: DataFrame) -> DataFrame:
    return evaluate.best_threshold(df, 1.0, 4.0)


# Model tables, with one fixed rule per region in place of a trained model.

CUTS = [0.3, 0.5, 0.7]

TABLE_SQL = (
    CONTACTS
    + """, s AS (SELECT (balance + 1000) / 11000 AS score, CASE WHEN y = 'yes' THEN 1 ELSE 0 END AS label FROM contacts),
  runs AS ("""
    + " UNION ALL ".join(
        f"""SELECT 'cut {c}' AS model, {i}::BIGINT AS pos, count(*) FILTER (label = 1 AND score >= {c})::DOUBLE AS tp,
    count(*) FILTER (label = 0 AND score >= {c})::DOUBLE AS fp, count(*) FILTER (label = 1 AND score < {c})::DOUBLE AS fn,
    count(*) FILTER (label = 0 AND score < {c})::DOUBLE AS tn FROM s"""
        for i, c in enumerate(CUTS)
    )
    + """), metrics AS (SELECT model, pos, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision,
    round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM runs)
"""
)


def metric_tables(spark: SparkSession, directory: str) -> list[DataFrame]:
    df = contacts(spark, directory, ["balance", "y"])
    score = (F.col("balance") + 1000) / 11000
    label = F.when(F.col("y") == "yes", 1).otherwise(0)
    out = []
    for i, c in enumerate(CUTS):
        run = df.select(label.alias("label"), F.when(score >= c, 1).otherwise(0).alias("prediction"))
        m = evaluate.binary_metrics(run)
        out.append(m.select(F.lit(f"cut {c}").alias("model"), F.lit(i).alias("pos"), *m.columns))
    return out


@query("compare_models", TABLE_SQL + "SELECT * FROM metrics ORDER BY f1 DESC, model")
def compare_models(spark: SparkSession, directory: str) -> DataFrame:
    return neat(evaluate.compare_models(metric_tables(spark, directory)))


@query("select_best", TABLE_SQL + "SELECT * FROM metrics ORDER BY f1 DESC, pos LIMIT 1")
def select_best(spark: SparkSession, directory: str) -> DataFrame:
    table = evaluate.compare_models(metric_tables(spark, directory))
    return neat(evaluate.select_best(table, "f1", "pos"))


@query(
    "scaling_improvement",
    TABLE_SQL
    + """SELECT 'cut' AS family, round(100 * (b.precision - a.precision) / a.precision, 3) + 0.0 AS precision_change_pct,
    round(100 * (b.recall - a.recall) / a.recall, 3) + 0.0 AS recall_change_pct
  FROM metrics a, metrics b WHERE a.model = 'cut 0.3' AND b.model = 'cut 0.5'""",
)
def scaling_improvement(spark: SparkSession, directory: str) -> DataFrame:
    raw, scaled, _ = metric_tables(spark, directory)
    pair = raw.withColumn("scaled", F.lit(False)).unionByName(scaled.withColumn("scaled", F.lit(True)))
    pair = pair.withColumn("family", F.lit("cut"))
    return neat(evaluate.scaling_improvement(neat(pair)), 3)


@query("roc_auc_of_labelled_documents", """WITH scored AS (
    SELECT ln(1 + n_chars) AS score, quality AS label FROM documents JOIN labels USING (doc_id))""" + POINTS + AUC)
def roc_auc_documents(spark: SparkSession, directory: str) -> DataFrame:
    docs = read_table(spark, directory, "documents").select("doc_id", F.log1p("n_chars").alias("score"))
    labels = read_table(spark, directory, "labels").select("doc_id", F.col("quality").alias("label"))
    return neat(evaluate.roc_auc(docs.join(labels, "doc_id")))
