"""Readers and sinks, by round trip."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from campaignlens.operators.rates import response_rate, response_share
from campaignlens.operators.rules import propensity_tier
from campaignlens.plans.catalog.common import CONTACTS, SCORED, neat, query, with_score
from campaignlens.plans.catalog.rate_queries import plain
from campaignlens.plans.contacts import contacts
from campaignlens.schema import CONTACT
from campaignlens.session import shared_dir
from campaignlens.sources import readers, sinks

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def contact_file(spark: SparkSession, directory: str) -> str:
    """The contact view with all seventeen columns, written as delimited text."""

    def flag(test):
        return F.when(test, "yes").otherwise("no")

    rows = contacts(spark, directory).select(
        (F.col("nation_key") + 18).cast("int").alias("age"),
        "job",
        "marital",
        F.col("contact").alias("education"),
        flag(F.col("balance") < 0).alias("default"),
        F.floor("balance").cast("int").alias("balance"),
        flag(F.col("marital") == "F").alias("housing"),
        flag(F.col("marital") == "P").alias("loan"),
        "contact",
        F.col("day").cast("int").alias("day"),
        "month",
        F.floor("duration").cast("int").alias("duration"),
        F.col("campaign").cast("int").alias("campaign"),
        F.col("pdays").cast("int").alias("pdays"),
        F.col("previous").cast("int").alias("previous"),
        "poutcome",
        "y",
    )
    path = shared_dir(spark, "contact-file")
    sinks.write_contacts(rows, path)
    return path


FILE_SQL = """,
file AS (
  SELECT nation_key + 18 AS age, job, marital, contact AS education,
         CASE WHEN balance < 0 THEN 'yes' ELSE 'no' END AS "default",
         CAST(floor(balance) AS BIGINT) AS balance,
         CASE WHEN marital = 'F' THEN 'yes' ELSE 'no' END AS housing,
         CASE WHEN marital = 'P' THEN 'yes' ELSE 'no' END AS loan,
         contact, day, month, CAST(floor(duration) AS BIGINT) AS duration, campaign, pdays, previous, poutcome, y
  FROM contacts)
"""


@query("read_contacts_declared", CONTACTS + FILE_SQL + "SELECT * FROM file")
def read_declared(spark: SparkSession, directory: str) -> DataFrame:
    return neat(readers.read_contacts(spark, contact_file(spark, directory), schema=CONTACT))


@query(
    "read_contacts_inferred",
    CONTACTS
    + FILE_SQL
    + """SELECT job, housing, count(*) AS n, min(age) AS youngest, CAST(sum(duration) AS BIGINT) AS seconds,
  round(avg(balance), 6) AS balance FROM file GROUP BY job, housing""",
)
def read_inferred(spark: SparkSession, directory: str) -> DataFrame:
    rows = readers.read_contacts(spark, contact_file(spark, directory), schema=None)
    return neat(
        rows.groupBy("job", "housing").agg(
            F.count("*").alias("n"),
            F.min("age").alias("youngest"),
            F.sum("duration").alias("seconds"),
            F.avg("balance").alias("balance"),
        )
    )


@query(
    "read_contact_files",
    CONTACTS
    + FILE_SQL
    + "SELECT 2 * count(*) AS n, 2 * count(*) FILTER (y = 'yes') AS hits FROM file",
)
def read_several(spark: SparkSession, directory: str) -> DataFrame:
    path = contact_file(spark, directory)
    rows = readers.read_contacts(spark, [path, path])
    return rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("y") == "yes", 1)).alias("hits"))


@query(
    "read_table",
    " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in TABLES),
)
def read_tables(spark: SparkSession, directory: str) -> DataFrame:
    out = None
    for t in TABLES:
        n = readers.read_table(spark, directory, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query(
    "experiment_log",
    CONTACTS
    + """SELECT 'segments' AS experiment, job AS run_name, CAST(count(*) AS DOUBLE) AS n,
  round(avg(CASE WHEN y = 'yes' THEN 100.0::DOUBLE ELSE 0 END), 6) AS rate FROM contacts GROUP BY job""",
)
def experiment_log(spark: SparkSession, directory: str) -> DataFrame:
    rates = response_rate(contacts(spark, directory, ["job", "y"]), "job")
    metric = [
        F.struct(F.lit("metric").alias("kind"), F.lit(k).alias("key"), F.col(c).cast("string").alias("value"))
        for k, c in (("n", "rows"), ("rate", "rate"))
    ]
    param = F.struct(F.lit("param").alias("kind"), F.lit("dimension").alias("key"), F.lit("job").alias("value"))
    runs = rates.select(
        F.lit("segments").alias("experiment"),
        F.md5("level").alias("run_id"),
        F.col("level").alias("run_name"),
        F.inline(F.array(param, *metric)),
    )
    path = shared_dir(spark, "runs")
    sinks.write_runs(runs, path)
    return neat(sinks.run_table(sinks.read_runs(spark, path, "segments"), ["n", "rate"]).drop("run_id"))


@query(
    "score_list_sink",
    CONTACTS
    + SCORED
    + """SELECT id, score, CASE WHEN score > 0.6 THEN 'high' WHEN score >= 0.3 THEN 'medium' ELSE 'low' END AS tier
  FROM scored""",
)
def score_list(spark: SparkSession, directory: str) -> DataFrame:
    scored = with_score(contacts(spark, directory, ["id", "balance", "y"])).select("id", "score")
    path = shared_dir(spark, "scores")
    sinks.write_scores(propensity_tier(scored, "score"), path)
    return spark.read.parquet(path).select("id", "score", "tier")


def _file_shares(dim: str) -> None:
    """Shares and rates by a column that only the contact file has."""
    level = f'CAST("{dim}" AS VARCHAR) AS level'

    @query(
        f"response_share_{dim}",
        CONTACTS + FILE_SQL + f"""SELECT {level}, round(count(*) FILTER (y = 'no')::DOUBLE / count(*), 6) AS no_share,
  round(count(*) FILTER (y = 'yes')::DOUBLE / count(*), 6) AS yes_share FROM file GROUP BY "{dim}\"""",
    )
    def shares(spark: SparkSession, directory: str) -> DataFrame:
        rows = readers.read_contacts(spark, contact_file(spark, directory))
        return plain(response_share(rows, dim)).withColumn("level", F.col("level").cast("string"))

    @query(
        f"response_rate_{dim}",
        CONTACTS + FILE_SQL + f"""SELECT {level}, count(*) AS n, round(avg(CASE WHEN y = 'yes' THEN 100.0::DOUBLE ELSE 0 END), 6) AS rate
  FROM file GROUP BY "{dim}\"""",
    )
    def share_rates(spark: SparkSession, directory: str) -> DataFrame:
        rows = readers.read_contacts(spark, contact_file(spark, directory))
        return plain(response_rate(rows, dim)).withColumn("level", F.col("level").cast("string"))


for _dim in ("age", "default", "education", "housing", "loan"):
    _file_shares(_dim)
