"""Segments: deterministic profiles and trained clusters."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from campaignlens.operators import segments, silhouette
from campaignlens.plans.catalog.common import CONTACTS, neat, on_contacts, query
from campaignlens.plans.contacts import contacts
from campaignlens.plans.segmentation import segment
from campaignlens.session import written
from campaignlens.sources.readers import read_table

MEANS = ["balance", "duration", "campaign", "previous"]
MODES = ["job", "marital", "contact"]
FLAGS = {"marital": "F", "poutcome": "O"}
RATE = "round(avg(CASE WHEN y = 'yes' THEN 100.0::DOUBLE ELSE 0 END), 6)"
CLUSTERED = ", k AS (SELECT *, nation_key % 4 AS cluster FROM contacts)\n"


def clustered(df: DataFrame) -> DataFrame:
    return df.withColumn("cluster", F.col("nation_key") % 4)


def mode_sql(c: str) -> str:
    return f"""(SELECT {c} FROM k i WHERE i.cluster = k.cluster GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"""


SEGMENT = "CASE WHEN {r} > 20 THEN 'HIGH-VALUE PROSPECTS' WHEN {r} > 19 THEN 'MODERATE PROSPECTS' ELSE 'LOW ENGAGEMENT' END AS segment"
DEFAULT_SEGMENT = (
    "CASE WHEN {r} > 15 THEN 'HIGH-VALUE PROSPECTS' WHEN {r} > 10 THEN 'MODERATE PROSPECTS' ELSE 'LOW ENGAGEMENT' END AS segment"
)


@on_contacts(
    "cluster_sizes",
    "nation_key",
    CLUSTERED
    + """SELECT cluster, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM k), 6) AS pct
  FROM k GROUP BY cluster""",
)
def cluster_sizes(df: DataFrame) -> DataFrame:
    return neat(segments.cluster_sizes(clustered(df)).withColumnRenamed("rows", "n"))


@on_contacts(
    "profile_clusters",
    " ".join(sorted({"nation_key", "y", *MEANS, *MODES, *FLAGS})),
    CLUSTERED
    + ", m AS ("
    + " UNION ALL ".join(
        f"""SELECT cluster, '{c}' AS name, {c} AS level, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, {c}) AS seat
    FROM k GROUP BY cluster, {c}"""
        for c in MODES
    )
    + "), w AS (SELECT cluster, "
    + ", ".join(f"max(level) FILTER (name = '{c}') AS mode_{c}" for c in MODES)
    + " FROM m WHERE seat = 1 GROUP BY cluster) SELECT cluster, count(*) AS n, "
    + ", ".join(f"round(avg({c}), 6) AS mean_{c}" for c in MEANS)
    + ", "
    + ", ".join(f"round(avg(CASE WHEN {c} = '{v}' THEN 100.0::DOUBLE ELSE 0 END), 6) AS pct_{c}" for c, v in FLAGS.items())
    + f""", {RATE} AS response_rate, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM k), 6) AS pct,
  mode_job, mode_marital, mode_contact, {DEFAULT_SEGMENT.format(r=RATE)}
  FROM k JOIN w USING (cluster) GROUP BY cluster, mode_job, mode_marital, mode_contact""",
)
def profile_clusters(df: DataFrame) -> DataFrame:
    return neat(segments.profile_clusters(clustered(df), MEANS, MODES, FLAGS).withColumnRenamed("rows", "n"))


@on_contacts(
    "label_clusters",
    "nation_key y",
    CLUSTERED + f"SELECT cluster, {RATE} AS response_rate, {SEGMENT.format(r=RATE)} FROM k GROUP BY cluster",
)
def label_clusters(df: DataFrame) -> DataFrame:
    found = segments.profile_clusters(clustered(df), [], [], {}).select("cluster", "response_rate")
    return neat(segments.label_clusters(found, hi=20, mid=19))


@on_contacts(
    "cluster_vs_overall",
    "nation_key y",
    CLUSTERED
    + f"""SELECT cluster AS level, count(*) AS n, {RATE} AS rate,
    (SELECT {RATE} FROM contacts) AS overall FROM k GROUP BY cluster""",
)
def cluster_vs_overall(df: DataFrame) -> DataFrame:
    rates, _ = segments.cluster_vs_overall(clustered(df))
    return neat(rates.withColumnRenamed("rows", "n"))


@on_contacts(
    "best_worst_cluster",
    "nation_key y",
    CLUSTERED
    + f""", r AS (SELECT cluster AS level, {RATE} AS rate FROM k GROUP BY cluster)
  SELECT first(level ORDER BY rate DESC, level) AS best, max(rate) AS best_rate,
    first(level ORDER BY rate, level) AS worst, min(rate) AS worst_rate, round(max(rate) - min(rate), 5) AS spread FROM r""",
)
def best_worst_cluster(df: DataFrame) -> DataFrame:
    _, extremes = segments.cluster_vs_overall(clustered(df))
    found = neat(extremes)
    return found.withColumn("spread", F.round(F.col("best_rate") - F.col("worst_rate"), 5))


NUMERIC = ["balance", "duration", "campaign", "day", "previous", "pdays"]
CATEGORICAL = ["job", "marital", "contact", "month", "poutcome"]


def embedding_vectors(spark: SparkSession, directory: str) -> DataFrame:
    vectors = read_table(spark, directory, "embeddings")
    return vectors.select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


KS = range(2, 11)


@query("kmeans_sweep", f"SELECT k, TRUE AS sums_fit, TRUE AS in_range FROM (VALUES {', '.join(f'({k})' for k in KS)}) AS t(k)")
def kmeans_sweep(spark: SparkSession, directory: str) -> DataFrame:
    """Per k: the inertia is the sum of squared distances to the nearest centre, the silhouette lies in [-1, 1]."""
    vectors = written(embedding_vectors(spark, directory), "vectors")
    sweep, found = segments.sweep_models(vectors, KS, "features", starts=10, seed=42, max_iter=300)
    sums = [inertia_by_hand(model, vectors).select(F.lit(k).alias("k"), "inertia_again") for k, model in found.items()]
    checked = sweep.join(reduce(DataFrame.union, sums), "k")
    close = F.abs(F.col("inertia") - F.col("inertia_again")) <= 1e-6 * F.col("inertia_again")
    return checked.select("k", close.alias("sums_fit"), F.col("silhouette").between(-1, 1).alias("in_range"))


def distances(model, vectors: DataFrame) -> DataFrame:
    """Squared distance of every vector to every centre (an array), by SQL functions."""
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    squared = F.transform(
        centres,
        lambda c: F.aggregate(F.zip_with(c, F.col("_x"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d),
    )
    return vectors.withColumn("_x", vector_to_array("features")).withColumn("_d", squared)


def inertia_by_hand(model, vectors: DataFrame) -> DataFrame:
    return distances(model, vectors).agg(F.sum(F.array_min("_d")).alias("inertia_again"))


@query("choose_k", "SELECT measure, TRUE AS largest, TRUE AS among_ks FROM (VALUES ('silhouette'), ('euclidean')) AS t(measure)")
def choose_k(spark: SparkSession, directory: str) -> DataFrame:
    """No k of the sweep has a larger silhouette than the chosen one, by squared and by plain distances."""
    sweep = written(segments.kmeans_sweep(embedding_vectors(spark, directory), KS, key="vec_id"), "sweep")
    chosen = []
    for by in ("silhouette", "euclidean"):
        top = sweep.agg(F.max(by)).scalar()
        among = F.col("k").between(min(KS), max(KS)).alias("among_ks")
        chosen.append(segments.choose_k(sweep, by).select(F.lit(by).alias("measure"), (F.col(by) == top).alias("largest"), among))
    return reduce(DataFrame.unionByName, chosen)


@query("segment_contacts", CONTACTS + f"SELECT count(*) AS n, {RATE} AS response_rate, round(avg(balance), 6) AS mean_balance FROM contacts")
def segment_contacts(spark: SparkSession, directory: str) -> DataFrame:
    """The whole flow on the contact view; the segments' sizes and rates add up to those of all contacts."""
    df = contacts(spark, directory, ["id", *NUMERIC, *CATEGORICAL, "y"])
    _, assigned = segment(df, "id", NUMERIC, CATEGORICAL)
    profiles = segments.profile_clusters(assigned, MEANS, MODES, FLAGS)
    share = F.col("rows") / F.sum("rows").over(Window.partitionBy())  # a row per segment
    shares = profiles.withColumn("_s", share)
    return neat(
        shares.agg(
            F.sum("rows").alias("n"),
            F.sum(F.col("response_rate") * F.col("_s")).alias("response_rate"),
            F.sum(F.col("mean_balance") * F.col("_s")).alias("mean_balance"),
        )
    )


@query("assign_clusters", "SELECT vec_id, TRUE AS nearest FROM embeddings")
def assign_clusters(spark: SparkSession, directory: str) -> DataFrame:
    """Every vector is in the cluster of its nearest centre."""
    vectors = embedding_vectors(spark, directory)
    model = segments.fit_kmeans(vectors, 10)
    found = distances(model, segments.assign_clusters(model, vectors))
    return found.select("vec_id", (F.get("_d", F.col("cluster")) <= F.array_min("_d") + 1e-9).alias("nearest"))


# Distances of the rows that come first by draw to all rows, by cluster.
DRAWN_ROWS = """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x, row_number() OVER (ORDER BY md5('42:' || vec_id)) AS seat FROM embeddings),
  m AS (SELECT a.vec_id, a.label, b.label AS other, sum(list_distance(a.x, b.x)) AS total, count(*) AS n
    FROM v a JOIN v b ON a.seat <= {drawn} GROUP BY a.vec_id, a.label, b.label),
  s AS (SELECT vec_id, label, max(total / (n - 1)) FILTER (label = other) AS inward, min(total / n) FILTER (label <> other) AS outward FROM m GROUP BY vec_id, label),
  r AS (SELECT *, (outward - inward) / greatest(inward, outward) AS silhouette FROM s)
"""


@query("silhouettes", DRAWN_ROWS.format(drawn=300) + 'SELECT vec_id, label, round(inward, 6) AS "inner", round(outward, 6) AS "outer", round(silhouette, 6) AS silhouette FROM r')
def silhouettes(spark: SparkSession, directory: str) -> DataFrame:
    """Euclidean silhouettes of 300 drawn vectors against all vectors, clustered by their label."""
    vectors = read_table(spark, directory, "embeddings")
    return neat(silhouette.silhouettes(vectors, "vec_id", "embedding", "label", drawn=300))


@query(
    "euclidean_silhouette",
    DRAWN_ROWS.format(drawn=300)
    + """SELECT round(avg(silhouette), 6) AS silhouette,
    round(sqrt(var_samp(silhouette) / count(*) * (1 - count(*)::DOUBLE / (SELECT count(*) FROM embeddings))), 6) AS error, count(*) AS n FROM r""",
)
def euclidean_silhouette(spark: SparkSession, directory: str) -> DataFrame:
    vectors = read_table(spark, directory, "embeddings")
    return neat(silhouette.euclidean_silhouette(vectors, "vec_id", "embedding", "label", drawn=300).withColumnRenamed("rows", "n"))
