"""Neighbours checked in SQL; trained models by what must hold of them whatever the fit: rows, labels, gradients, sums, orders."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from campaignlens.operators import hashed, models, neighbors, prep, segments
from campaignlens.operators.evaluate import binary_metrics, compare_models, confusion, roc_auc, scaling_improvement
from campaignlens.operators.oversample import smote
from campaignlens.operators.ranking import cumulative_share, rows_to_reach
from campaignlens.plans.catalog.common import CONTACTS, neat, query
from campaignlens.plans.contacts import contacts
from campaignlens.plans.modelling import Prepared, bake_off, prepare, scaled_runs, winner
from campaignlens.session import shared_dir, written
from campaignlens.sources.readers import read_table
from campaignlens.sources.sinks import load_model, run_rows, run_table, save_model, write_runs, read_runs

# The balanced, split contact rows in SQL, after CONTACTS. The draw decides alone.
PARTS = """, drawn AS (
  SELECT id, CASE WHEN y = 'yes' THEN 1 ELSE 0 END AS label,
         row_number() OVER (PARTITION BY y ORDER BY md5('42:' || id)) AS seat FROM contacts),
base AS (SELECT * FROM drawn WHERE {keep}),
sizes AS (
  SELECT label, count(*) AS n, count(*) * ceil(0.2 * sum(count(*)) OVER ()) / sum(count(*)) OVER () AS want,
         ceil(0.2 * sum(count(*)) OVER ()) AS goal FROM base GROUP BY label),
takes AS (
  SELECT label, floor(want) + CASE WHEN row_number() OVER (ORDER BY want - floor(want) DESC, label)
           <= goal - sum(floor(want)) OVER () THEN 1 ELSE 0 END AS take FROM sizes),
parts AS (
  SELECT b.id, b.label, row_number() OVER (PARTITION BY b.label ORDER BY md5('43:' || b.id)) <= take AS is_test
  FROM base b JOIN takes t ON b.label = t.label)
"""
EVEN = CONTACTS + PARTS.format(keep="seat <= (SELECT min(n) FROM (SELECT count(*) AS n FROM contacts GROUP BY y))")
WHOLE = CONTACTS + PARTS.format(keep="TRUE")
TEST_ROWS = "SELECT id, CAST(label AS BIGINT) AS label, TRUE AS in_range, TRUE AS agrees FROM parts WHERE is_test"
FIVE = ("Logistic Regression", "Random Forest", "Gradient Boosting", "K-Nearest Neighbors", "Support Vector Machine")

NUMERIC = ["balance", "duration", "campaign", "day", "previous", "pdays"]
CATEGORICAL = ["job", "marital", "contact", "month", "poutcome"]

KNN = """WITH ranked AS (
    SELECT vec_id, embedding::DOUBLE[] AS v, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || vec_id)) AS seat,
      count(*) OVER (PARTITION BY label) AS n, count(*) OVER () AS total FROM embeddings),
  sizes AS (SELECT label, any_value(n) AS n, any_value(total) AS total, ceil(any_value(total) * 0.2) AS goal FROM ranked GROUP BY label),
  takes AS (SELECT label, floor(n * goal / total) + CASE WHEN row_number() OVER (
      ORDER BY n * goal / total - floor(n * goal / total) DESC, CAST(label AS VARCHAR)) <= goal - sum(floor(n * goal / total)) OVER ()
      THEN 1 ELSE 0 END AS take FROM sizes),
  parts AS (SELECT r.*, seat <= take AS is_test FROM ranked r JOIN takes USING (label)),
  pairs AS (SELECT q.vec_id AS vec_id, t.vec_id AS neighbour, t.label AS label, list_distance(q.v, t.v) AS distance
    FROM parts q JOIN parts t ON q.is_test AND NOT t.is_test),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour) AS r FROM pairs) WHERE r <= 5)
"""


def split_embeddings(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    vectors = read_table(spark, directory, "embeddings")
    parts = prep.stratified_split(vectors, "label", "vec_id")
    return parts.filter(F.col("split") == "train"), parts.filter(F.col("split") == "test")


@query("nearest_neighbours", KNN + "SELECT vec_id, neighbour, round(distance, 6) AS distance, r AS place FROM best")
def nearest_neighbours(spark: SparkSession, directory: str) -> DataFrame:
    train, test = split_embeddings(spark, directory)
    found = neighbors.nearest(train, test, 5, "vec_id", "embedding")
    return neat(found.select(F.col("query").alias("vec_id"), "neighbour", "distance", F.col("rank").alias("place")))


@query(
    "nearest_hashed",
    KNN + """SELECT count(DISTINCT vec_id) AS queries, count(*) AS wanted, TRUE AS verified, TRUE AS recall_reached FROM best""",
)
def nearest_hashed(spark: SparkSession, directory: str) -> DataFrame:
    """The hash index against the exact operator: its recall, and whether each distance is that of the two vectors."""
    train, test = split_embeddings(spark, directory)
    found = written(hashed.nearest_hashed(train, test, 5, "vec_id", "embedding"), "hashed-found")
    truth = written(neighbors.nearest(train, test, 5, "vec_id", "embedding"), "exact-found")
    of, to = (df.select(F.col("vec_id").alias(c), F.col("embedding").cast("array<double>").alias(v)) for df, c, v in ((test, "query", "q"), (train, "neighbour", "t")))
    gap = F.aggregate(F.zip_with("q", "t", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)
    fits = F.bool_and(F.abs(F.sqrt(gap) - F.col("distance")) < 1e-9)
    verified = found.join(of, "query").join(to, "neighbour").agg(fits).scalar()
    asked = truth.agg(F.count_distinct("query")).scalar()
    reached = F.col("recall") >= 0.9
    return hashed.recall_of(found, truth).select(asked.alias("queries"), "wanted", verified.alias("verified"), reached.alias("recall_reached"))


@query(
    "knn_classify",
    KNN
    + """, votes AS (SELECT vec_id, label, count(*) AS votes FROM best GROUP BY vec_id, label)
  SELECT vec_id, first(label ORDER BY votes DESC, label)::DOUBLE AS prediction, max(votes) AS votes,
    round(coalesce(sum(votes) FILTER (label = 1), 0)::DOUBLE / sum(votes), 6) AS score FROM votes GROUP BY vec_id""",
)
def knn_classify(spark: SparkSession, directory: str) -> DataFrame:
    train, test = split_embeddings(spark, directory)
    return neat(neighbors.knn_classify(train, test, "vec_id", "embedding", "label", 5))


def prepared(spark: SparkSession, directory: str, balance: str = "all") -> Prepared:
    df = contacts(spark, directory, ["id", *NUMERIC, *CATEGORICAL, "y"])
    return prepare(df, "id", NUMERIC, CATEGORICAL, balance=balance)


def names(values: Iterable[str], name: str, columns: str) -> str:
    """SQL with a row per name."""
    return f"SELECT {name}, {columns} FROM (VALUES {', '.join(f"('{v}')" for v in values)}) AS t({name})"


def scored_rows(fitted: models.Fitted, test: DataFrame) -> DataFrame:
    """Every test row with its label, whether its score is a probability, and whether the prediction follows from it."""
    agrees = F.col("prediction") == (F.col("score") > 0.5).cast("int")
    return fitted.score(test).select(
        "id", F.col("label").cast("long").alias("label"), F.col("score").between(0, 1).alias("in_range"), agrees.alias("agrees")
    )


@query("train_logistic", EVEN + TEST_ROWS)
def train_logistic(spark: SparkSession, directory: str) -> DataFrame:
    p = prepared(spark, directory)
    return scored_rows(models.train_logistic(p.train_scaled, p.features), p.test_scaled)


@query("train_logistic_weighted", WHOLE + TEST_ROWS)
def train_logistic_weighted(spark: SparkSession, directory: str) -> DataFrame:
    """Class weights on the full training rows in place of undersampling; test rows keep their shares."""
    p = prepared(spark, directory, balance="none")
    train = prep.class_weights(p.train_scaled, "label")
    return scored_rows(models.train_logistic(train, p.features, weight="weight"), p.test_scaled)


@query("train_forest", EVEN + TEST_ROWS)
def train_forest(spark: SparkSession, directory: str) -> DataFrame:
    p = prepared(spark, directory)
    return scored_rows(models.train_forest(p.train, p.features), p.test)


@query("train_boosting", EVEN + TEST_ROWS)
def train_boosting(spark: SparkSession, directory: str) -> DataFrame:
    p = prepared(spark, directory)
    return scored_rows(models.train_boosting(p.train, p.features), p.test)


@query("train_neighbours", EVEN + TEST_ROWS)
def train_neighbours(spark: SparkSession, directory: str) -> DataFrame:
    p = prepared(spark, directory)
    return scored_rows(models.train_neighbors(p.train_scaled, p.features, "id"), p.test_scaled)


@query("train_rbf_svm", EVEN + TEST_ROWS)
def train_rbf_svm(spark: SparkSession, directory: str) -> DataFrame:
    """The margin decides and the score is fitted to it, so predictions are cut by one score, on either side."""
    p = prepared(spark, directory)
    scored = written(models.train_rbf_svm(p.train_scaled, p.features, "id").score(p.test_scaled), "svm-scores")
    yes, no = (F.when(F.col("prediction") == v, F.col("score")) for v in (1, 0))
    cut = scored.agg(
        F.coalesce((F.max(no) <= F.min(yes)) | (F.max(yes) <= F.min(no)), F.lit(True)).alias("agrees")
    ).scalar()
    return scored.select("id", F.col("label").cast("long").alias("label"), F.col("score").between(0, 1).alias("in_range"), cut.alias("agrees"))


@query("train_without_leakage", EVEN + TEST_ROWS)
def train_without_leakage(spark: SparkSession, directory: str) -> DataFrame:
    """The forest without the column that is known only after the contact."""
    p = prepared(spark, directory)
    usable = [c for c in p.features if c != "duration"]
    return scored_rows(models.train_forest(p.train, usable), p.test)


@query(
    "train_forest_nominal",
    """SELECT o_orderpriority AS level, count(*) AS n, count(*) FILTER (o_orderpriority IN ('1-URGENT', '4-NOT SPECIFIED')) AS positives,
    0::BIGINT AS wrong_nominal, CASE WHEN o_orderpriority IN ('1-URGENT', '4-NOT SPECIFIED') THEN count(*) ELSE 0 END AS predicted_nominal,
    TRUE AS order_fails FROM orders GROUP BY 1""",
)
def train_forest_nominal(spark: SparkSession, directory: str) -> DataFrame:
    """One split separates two of five levels that no threshold on their codes parts: by sets it is exact.

    Per level: rows, positives, wrong and positive predictions of trees of one split by sets, and
    whether trees of one split by order are wrong somewhere.
    """
    orders = read_table(spark, directory, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("level"))
    known = prep.fit_label_dictionary(orders, ["level"])
    coded = prep.encode(orders.withColumn("code", F.col("level")), known.withColumn("column", F.lit("code")), ["code"])
    rows = written(coded.withColumn("label", F.col("level").isin("1-URGENT", "4-NOT SPECIFIED").cast("int")), "nominal")
    sizes = {"code": prep.level_counts(known, ["level"])["level"]}
    by_sets = models.train_forest(rows, ["code"], trees=5, depth=1, nominal=sizes, key="id").score(rows)
    by_order = models.train_forest(rows, ["code"], trees=5, depth=1, key="id").score(rows)
    fails = by_order.agg(F.bool_or(F.col("prediction") != F.col("label"))).scalar()
    wrong = F.count(F.when(F.col("prediction") != F.col("label"), 1))
    return by_sets.groupBy("level").agg(
        F.count("*").alias("n"),
        F.sum(F.col("label").cast("long")).alias("positives"),
        wrong.alias("wrong_nominal"),
        F.sum(F.col("prediction").cast("long")).alias("predicted_nominal"),
    ).withColumn("order_fails", fails)


FILE_ROWS = 1_000_000


@query("same_fit_any_layout", EVEN + "SELECT id, CAST(label AS BIGINT) AS label, TRUE AS same_score, TRUE AS same_cluster FROM parts")
def same_fit_any_layout(spark: SparkSession, directory: str) -> DataFrame:
    """The balanced rows in one file and in thirteen, dealt otherwise: per row, whether forest score and cluster agree.

    Of more than FILE_ROWS rows there are more files, thirteen times as many in the second layout, so
    that no task writes a file of any size. Clusters are those of the nearest of three centres; they agree if their centres do to nine digits.
    """
    p = prepared(spark, directory)
    rows = p.train_scaled.unionByName(p.test_scaled)
    files = max(1, -(-rows.count() // FILE_ROWS))
    one = written(rows.repartition(files, F.col("id")), "one-file")
    many = written(rows.repartition(13 * files, F.col("balance")), "thirteen-files")

    def fit(table: DataFrame) -> DataFrame:
        forest = models.train_forest(table, p.features, trees=20, depth=5, key="id")
        means = segments.fit_kmeans(prep.assemble(table, p.features), 3, starts=2, max_iter=20, key="id")
        centre = F.array(*[F.concat_ws(" ", F.array(*[F.lit(f"{round(v, 9) + 0.0:.9f}") for v in c])) for c in means.clusterCenters()])
        scored = forest.score(one).select("id", "label", "score")
        placed = means.transform(prep.assemble(one, p.features)).select("id", centre[F.col("cluster")].alias("centre"))
        return scored.join(placed, "id")

    first, second = fit(one), fit(many).select("id", F.col("score").alias("_score"), F.col("centre").alias("_centre"))
    return first.join(second, "id").select(
        "id",
        F.col("label").cast("long").alias("label"),
        (F.col("score") == F.col("_score")).alias("same_score"),
        (F.col("centre") == F.col("_centre")).alias("same_cluster"),
    )


SHARES = ("accuracy", "precision", "recall", "f1")


def recomputed(runs: dict[str, tuple[models.Fitted, DataFrame]]) -> DataFrame:
    """Per run its test rows, positives and metrics, from rows scored anew, written and counted by plain sums.

    The area under the curve is MLlib's, by thresholds; the library's own is by ranks.
    """
    scored = None
    for name, (fitted, test) in runs.items():
        one = fitted.score(test).select(F.lit(name).alias("run"), "label", "prediction", "score")
        scored = one if scored is None else scored.unionByName(one)
    scored = written(scored, "scored-again")

    def rows(actual: int, guess: int) -> Column:
        return F.sum(F.when((F.col("label") == actual) & (F.col("prediction") == guess), 1).otherwise(0))

    tn, fp, fn, tp = (rows(a, g) for a in (0, 1) for g in (0, 1))
    judge = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0)
    areas = F.create_map(*[F.lit(v) for n in runs for v in (n, judge.evaluate(scored.filter(F.col("run") == n)))])
    counted = scored.groupBy("run").agg(
        F.count("*").alias("n_test"),
        F.sum(F.col("label").cast("long")).alias("n_positive"),
        ((tp + tn) / F.count("*")).alias("accuracy_again"),
        F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)).alias("precision_again"),
        F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)).alias("recall_again"),
        F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1_again"),
    )
    return counted.withColumn("roc_auc_again", areas[F.col("run")])


def metrics_fit(metrics: Sequence[str]) -> Column:
    return reduce(and_, [F.abs(F.col(m) - F.col(f"{m}_again")) < 1e-9 for m in metrics])


def test_counts(runs: Iterable[str], name: str, columns: str) -> str:
    """SQL with the test rows and positives per run."""
    return EVEN + f"""SELECT {name}, count(*) AS n_test, CAST(sum(label) AS BIGINT) AS n_positive, {columns}
  FROM parts, (VALUES {', '.join(f"('{r}')" for r in runs)}) AS t({name}) WHERE is_test GROUP BY {name}"""


@query("bake_off", test_counts(FIVE, "model", "TRUE AS metrics_fit, TRUE AS area_fits, TRUE AS timed"))
def run_bake_off(spark: SparkSession, directory: str) -> DataFrame:
    """Per model: test rows, positives, and whether its metrics are those of its rows scored anew."""
    p = prepared(spark, directory)
    metrics, fitted = bake_off(p, "id")
    again = recomputed({name: (f, p.test_scaled) for name, f in fitted.items()})
    return compare_models([metrics]).join(again, F.col("model") == F.col("run")).select(
        "model",
        "n_test",
        "n_positive",
        metrics_fit(SHARES).alias("metrics_fit"),
        metrics_fit(["roc_auc"]).alias("area_fits"),
        (F.col("training_time_s") > 0).alias("timed"),
    )


@query(
    "bake_off_best",
    EVEN
    + f"""SELECT cell, n_actual, is_best, logged FROM (
  SELECT label AS actual, count(*) AS n_actual FROM parts WHERE is_test GROUP BY label) a
  JOIN (VALUES (0, 'tn'), (0, 'fp'), (1, 'fn'), (1, 'tp')) AS c(actual, cell) USING (actual),
  (SELECT TRUE AS is_best, {len(FIVE)} AS logged)""",
)
def bake_off_best(spark: SparkSession, directory: str) -> DataFrame:
    """The whole flow: train and log all five, take the best by F1, and look into its test rows.

    Per cell of the winner's confusion table: rows of its actual class over both cells,
    whether no logged run has a better F1, and the number of logged runs.
    """
    p = prepared(spark, directory)
    log = shared_dir(spark, "runs")
    best, scored = winner(p, "id", log)
    runs = run_table(read_runs(spark, log, "bake-off"), ["f1"])
    top, logged = runs.agg(F.max("f1")).scalar(), runs.agg(F.count("*").cast("int")).scalar()
    cells = confusion(scored)
    both = cells.groupBy("actual").agg(F.sum("rows").alias("n_actual"))
    return cells.join(both, "actual").select("cell", "n_actual", (F.lit(best["f1"]) >= top).alias("is_best"), logged.alias("logged"))


@query(
    "scaled_vs_unscaled",
    test_counts(("Random Forest", "Logistic Regression"), "family", "TRUE AS metrics_fit, TRUE AS precision_fits, TRUE AS recall_fits"),
)
def run_scaled_vs_unscaled(spark: SparkSession, directory: str) -> DataFrame:
    """The four runs against their rows scored anew, and scaling_improvement's relative changes against the four runs."""
    p = prepared(spark, directory)
    runs, fitted = scaled_runs(p)
    again = recomputed({f"{name}/{s}": (f, p.test_scaled if s else p.test) for (name, s), f in fitted.items()})
    runs = runs.withColumn("run", F.concat_ws("/", "family", F.initcap(F.col("scaled").cast("string")))).join(again, "run")
    checked = runs.groupBy("family").agg(
        F.max("n_test").alias("n_test"),
        F.min("n_positive").alias("n_positive"),
        (F.bool_and(metrics_fit([*SHARES, "roc_auc"])) & (F.count("*") == 2)).alias("metrics_fit"),
    )
    changes = scaling_improvement(runs)
    raw, scaled = (runs.filter(F.col("scaled") == s).select("family", *[F.col(m).alias(f"{m}_{s}") for m in ("precision", "recall")]) for s in (False, True))
    both = changes.join(raw, "family").join(scaled, "family").join(checked, "family")

    def fits(m: str) -> Column:
        before, after, change = F.col(f"{m}_False"), F.col(f"{m}_True"), F.col(f"{m}_change_pct")
        return F.when(before > 0, F.abs(before * (1 + change / 100) - after) < 1e-9).otherwise(change.isNull() | (change == 0)).alias(f"{m}_fits")

    return both.select("family", "n_test", "n_positive", "metrics_fit", fits("precision"), fits("recall"))


FEATURE_NAMES = [*NUMERIC, *CATEGORICAL]


def importance_from_nodes(spark: SparkSession, fitted: models.Fitted) -> DataFrame:
    """Importance per feature position from the nodes of the written forest.

    A split counts its gain times its rows, as a share of its tree's; trees count alike.
    """
    path = shared_dir(spark, "forest")
    fitted.model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").filter(F.col("leftChild") >= 0)
    rows = F.aggregate("impurityStats", F.lit(0.0), lambda a, x: a + x)
    splits = nodes.groupBy("treeID", F.col("split.featureIndex").alias("position")).agg(F.sum(F.col("gain") * rows).alias("gain"))
    trees = splits.groupBy("treeID").agg(F.sum("gain").alias("all_gain"))
    shares = splits.join(trees.filter(F.col("all_gain") > 0), "treeID")
    per = shares.groupBy("position").agg(F.sum(F.col("gain") / F.col("all_gain")).alias("share"))
    return per.select("position", (F.col("share") / per.agg(F.sum("share")).scalar()).alias("again"))


@query("feature_importance", names(FEATURE_NAMES, "feature", "TRUE AS from_nodes, 1.0::DOUBLE AS total, 100::BIGINT AS trees"))
def feature_importance(spark: SparkSession, directory: str) -> DataFrame:
    """Per feature whether its importance is that of the written nodes; the sum of all; the trees that were written."""
    p = prepared(spark, directory)
    fitted = models.train_forest(p.train, p.features)
    table = models.feature_importance(fitted, p.train).join(importance_from_nodes(spark, fitted), "position", "left")
    total = table.agg(F.round(F.sum("importance"), 6)).scalar()
    agrees = F.abs(F.col("importance") - F.coalesce("again", F.lit(0.0))) < 1e-9
    trees = F.lit(len(fitted.model.trees)).cast("long")
    return table.select("feature", agrees.alias("from_nodes"), total.alias("total"), trees.alias("trees"))


@query("features_to_reach", "SELECT threshold, TRUE AS reached, TRUE AS needed FROM (VALUES (0.8::DOUBLE), (0.9::DOUBLE)) AS t(threshold)")
def features_to_reach(spark: SparkSession, directory: str) -> DataFrame:
    """That many of the most important features reach the share, and one fewer do not."""
    p = prepared(spark, directory)
    table = written(models.feature_importance(models.train_forest(p.train, p.features), p.train), "importances")
    reach = rows_to_reach(cumulative_share(table, "feature", "importance"), [0.8, 0.9])
    # An entry per feature.
    falling = table.agg(F.sort_array(F.collect_list("importance"), asc=False)).scalar()

    def first(n: Column) -> Column:
        return F.aggregate(F.slice(F.col("_all"), F.lit(1), n.cast("int")), F.lit(0.0), lambda a, x: a + x)

    return reach.withColumn("_all", falling).select(
        "threshold",
        (first(F.col("rows")) >= F.col("threshold") - 1e-9).alias("reached"),
        (first(F.col("rows") - 1) < F.col("threshold") + 1e-9).alias("needed"),
    )


@query("coefficients", names(["(intercept)", *FEATURE_NAMES], "feature", "0.0::DOUBLE AS gradient"))
def coefficients(spark: SparkSession, directory: str) -> DataFrame:
    """The slope of the penalised mean loss along each coefficient, which is zero where the loss is smallest."""
    p = prepared(spark, directory)
    fitted = models.train_logistic(p.train_scaled, p.features)
    penalty = 1.0 / p.train_scaled.count()
    weights = {r["feature"]: r["coefficient"] for r in models.coefficients(fitted, p.train).collect()}
    miss = F.col("score") - F.col("label")
    row = fitted.score(p.train_scaled).agg(
        F.avg(miss).alias("(intercept)"), *[(F.avg(miss * F.col(f)) + penalty * weights[f]).alias(f) for f in p.features]
    )
    return row.unpivot([], ["(intercept)", *p.features], "feature", "slope").select("feature", (F.round("slope", 3) + 0.0).alias("gradient"))


@query(
    "importance_or_coefficients",
    " UNION ALL ".join(
        names(FEATURE_NAMES, "feature", f"'{m}' AS model, TRUE AS finite") for m in ("Random Forest", "Gradient Boosting", "Logistic Regression")
    ),
)
def importance_or_coefficients(spark: SparkSession, directory: str) -> DataFrame:
    """Every feature of the models that weigh features; neighbours and the kernel model give no rows."""
    p = prepared(spark, directory)
    found = None
    for fitted in (
        models.train_forest(p.train, p.features),
        models.train_boosting(p.train, p.features),
        models.train_logistic(p.train_scaled, p.features),
        models.train_neighbors(p.train_scaled, p.features, "id"),
        models.train_rbf_svm(p.train_scaled, p.features, "id"),
    ):
        one = models.importance_or_coefficients(fitted, p.train).withColumn("model", F.lit(fitted.name))
        found = one if found is None else found.unionByName(one)
    return found.select("feature", "model", (F.abs("value") < float("inf")).alias("finite"))


@query("permutation_importance", names(FEATURE_NAMES, "feature", "TRUE AS same_base, TRUE AS in_range"))
def permutation_importance(spark: SparkSession, directory: str) -> DataFrame:
    """The unshuffled ROC AUC is that of the test rows, and every loss lies between the AUC and its distance to one."""
    p = prepared(spark, directory)
    fitted = models.train_logistic(p.train_scaled, p.features)
    table = models.permutation_importance(fitted, p.test_scaled, "id")
    base = roc_auc(fitted.score(p.test_scaled)).first()["roc_auc"]
    return table.select(
        "feature",
        (F.abs(F.col("roc_auc") - base) < 1e-9).alias("same_base"),
        F.col("loss").between(F.col("roc_auc") - 1, F.col("roc_auc")).alias("in_range"),
    )


@query(
    "smote",
    CONTACTS
    + """, n AS (SELECT count(*) FILTER (y = 'yes') AS few, count(*) FILTER (y = 'no') AS many FROM contacts)
  SELECT label, synthetic, n::BIGINT AS n, parents::BIGINT AS parents, TRUE AS on_segment FROM (
    SELECT 0 AS label, FALSE AS synthetic, many AS n, 0 AS parents FROM n UNION ALL SELECT 1, FALSE, few, 0 FROM n
    UNION ALL SELECT 1, TRUE, many - few, least(few, many - few) FROM n)""",
)
def run_smote(spark: SparkSession, directory: str) -> DataFrame:
    """Rows and parents per class and kind, and whether each made row lies between its two minority parents."""
    cols = ["balance", "duration", "campaign"]
    df = contacts(spark, directory, ["id", *cols, "y"])
    coded = df.withColumn("label", F.when(F.col("y") == "yes", 1).otherwise(0)).drop("y")
    scaled = written(prep.standardize(coded, [], cols)[0], "smote-rows")
    made = smote(scaled, cols, "id", "label", parents=True)
    vector = F.array(*[F.col(c) for c in cols])
    minor = scaled.filter("label = 1")
    one, two = (minor.select(F.col("id").alias(k), vector.alias(v)) for k, v in (("parent", "_p"), ("neighbour", "_o")))
    both = made.withColumn("_m", vector).join(one, "parent", "left").join(two, "neighbour", "left")

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    def minus(a: str, b: str) -> Column:
        return F.zip_with(a, b, lambda x, y: x - y)

    # The place on the segment by projection, and the distance of the row from that place.
    step, way = minus("_o", "_p"), minus("_m", "_p")
    place = F.when(dot(step, step) > 0, dot(way, step) / dot(step, step)).otherwise(0.0)
    off = F.zip_with(way, step, lambda w, s: w - F.col("_place") * s)
    fits = F.col("_place").between(-1e-9, 1 + 1e-9) & (dot(F.col("_off"), F.col("_off")) < 1e-18)
    judged = both.withColumn("_place", place).withColumn("_off", off)
    return judged.groupBy("label", "synthetic").agg(
        F.count("*").alias("n"),
        F.count_distinct("parent").alias("parents"),
        F.bool_and(~F.col("synthetic") | F.coalesce(fits, F.lit(False))).alias("on_segment"),
    )


@query("model_round_trip", EVEN + "SELECT count(*) AS n, 0::BIGINT AS changed FROM parts WHERE is_test")
def model_round_trip(spark: SparkSession, directory: str) -> DataFrame:
    """Rows whose score changes when the model is written and read back: none."""
    p = prepared(spark, directory)
    fitted = models.train_logistic(p.train_scaled, p.features)
    path = shared_dir(spark, "model")
    save_model(fitted.model, path)
    again = models.Fitted("loaded", p.features, models._probability_scorer(load_model(path), p.features))
    before = fitted.score(p.test_scaled).select("id", "score")
    after = again.score(p.test_scaled).select("id", F.col("score").alias("again"))
    both = before.join(after, "id")
    return both.agg(F.count("*").alias("n"), F.count(F.when(F.col("score") != F.col("again"), 1)).alias("changed"))


@query("logged_run", "SELECT 'contacts' AS experiment, 'Logistic Regression' AS run_name, TRUE AS same_metrics, TRUE AS timed")
def logged_run(spark: SparkSession, directory: str) -> DataFrame:
    """A trained model's parameters and metrics written to the experiment log and read back."""
    p = prepared(spark, directory)
    fitted = models.train_logistic(p.train_scaled, p.features)
    metrics = {**models.evaluate(fitted, p.test_scaled), "training_time": fitted.seconds}
    runs = run_rows(spark, "contacts", fitted.name, {"model_type": fitted.name, **fitted.params}, metrics)
    path = shared_dir(spark, "runs")
    write_runs(runs, path)
    names = ["accuracy", "precision", "recall", "f1", "roc_auc"]
    read = run_table(read_runs(spark, path), [*names, "training_time"])
    same = reduce(and_, [F.col(m) == F.lit(float(metrics[m])) for m in names])
    return read.select("experiment", "run_name", same.alias("same_metrics"), (F.col("training_time") > 0).alias("timed"))


@query(
    "untouched_holdout",
    WHOLE + """SELECT count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives, TRUE AS in_range
  FROM parts WHERE is_test""",
)
def untouched_holdout(spark: SparkSession, directory: str) -> DataFrame:
    """The test rows keep their class shares, the training rows alone being balanced; the metrics are shares."""
    p = prepared(spark, directory, balance="train")
    fitted = models.train_logistic(p.train_scaled, p.features)
    scored = fitted.score(p.test_scaled)
    found = binary_metrics(scored).withColumn("roc_auc", roc_auc(scored).scalar())
    counts = scored.agg(F.count(F.when(F.col("label") == 1, 1)).alias("positives"), F.count(F.when(F.col("label") == 0, 1)).alias("negatives"))
    in_range = reduce(and_, [F.col(m).between(0, 1) for m in ("accuracy", "precision", "recall", "f1", "roc_auc")])
    return counts.withColumn("in_range", found.select(in_range).scalar())
