"""Projection, filter, preview, sampling, set operations, scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from campaignlens.functions import scalars as S
from campaignlens.operators import prep, profile, rates
from campaignlens.plans.catalog.common import CONTACTS, neat, on_contacts, on_table, query
from campaignlens.plans.contacts import COLUMNS, contacts
from campaignlens.schema import BALANCE_EDGES, BALANCE_LABELS, CAMPAIGN_EDGES, CAMPAIGN_LABELS
from campaignlens.sources.readers import read_table

ALL = " ".join(COLUMNS)


@on_contacts("contact_view", ALL, "SELECT * FROM contacts")
def contact_view(df: DataFrame) -> DataFrame:
    return df


@on_contacts("preview", ALL, "SELECT * FROM contacts ORDER BY id LIMIT 5")
def preview(df: DataFrame) -> DataFrame:
    return profile.preview(df, "id")


@on_contacts("preview_last", ALL, "SELECT * FROM contacts ORDER BY id DESC LIMIT 5")
def preview_last(df: DataFrame) -> DataFrame:
    return profile.preview_last(df, "id")


@on_contacts("sample_exact", ALL, "SELECT * FROM contacts ORDER BY md5('42:' || id) LIMIT 10")
def sample(df: DataFrame) -> DataFrame:
    return profile.sample_exact(df, 10, "id")


@on_table(
    "sample_exact_large",
    "lineitem",
    """SELECT l_orderkey FROM (SELECT DISTINCT l_orderkey FROM lineitem)
  ORDER BY md5('42:' || l_orderkey) LIMIT 10001""",
)
def sample_large(df: DataFrame) -> DataFrame:
    return profile.sample_exact(df.select("l_orderkey").distinct(), 10_001, "l_orderkey")


@on_contacts("dataset_shape", ALL, "SELECT count(*) AS n, 15::BIGINT AS c FROM contacts")
def dataset_shape(df: DataFrame) -> DataFrame:
    return profile.dataset_shape(df).toDF("n", "c")


TYPES = dict(
    zip(
        COLUMNS,
        "bigint bigint string string string bigint double double bigint bigint string bigint bigint string string".split(),
    )
)


@on_contacts(
    "schema_table",
    ALL,
    " UNION ALL ".join(
        f"SELECT {i}::BIGINT AS pos, '{c}' AS name, '{t}' AS kind, count({c}) AS non_null FROM contacts"
        for i, (c, t) in enumerate(TYPES.items(), 1)
    ),
)
def schema_table(df: DataFrame) -> DataFrame:
    present = profile.column_profile(df).select("column", "non_null")
    found = profile.schema_table(df).join(present, "column")
    return neat(found.select(F.col("position").alias("pos"), F.col("column").alias("name"), F.col("type").alias("kind"), "non_null"))


HOLES = """,
holes AS (
  SELECT id, CASE WHEN pdays >= 0 THEN pdays END AS gap,
         CASE WHEN poutcome <> 'unknown' THEN poutcome END AS outcome,
         CASE WHEN campaign = 0 THEN 'nan'::DOUBLE ELSE duration / campaign END AS per_line, y
  FROM contacts)
"""


def with_holes(df: DataFrame) -> DataFrame:
    """The contact view with real nulls and NaN in place of its fill values."""
    return df.select(
        "id",
        F.when(F.col("pdays") >= 0, F.col("pdays")).alias("gap"),
        F.when(F.col("poutcome") != "unknown", F.col("poutcome")).alias("outcome"),
        F.when(F.col("campaign") == 0, F.lit(float("nan")))
        .otherwise(S.ratio(F.col("duration"), F.col("campaign")))
        .alias("per_line"),
        "y",
    )


HOLE_COLUMNS = "id pdays poutcome campaign duration y"
PRESENT = {
    "id": "count(id)",
    "gap": "count(gap)",
    "outcome": "count(outcome)",
    "per_line": "count(*) FILTER (NOT isnan(per_line))",
    "y": "count(y)",
}


@on_contacts(
    "column_profile",
    HOLE_COLUMNS,
    HOLES
    + " UNION ALL ".join(
        f"SELECT '{c}' AS name, {n} AS non_null, '{t}' AS kind FROM holes"
        for (c, n), t in zip(PRESENT.items(), ["bigint", "bigint", "string", "double", "string"])
    ),
)
def column_profile(df: DataFrame) -> DataFrame:
    return profile.column_profile(with_holes(df)).toDF("name", "non_null", "kind")


@on_contacts(
    "missing_report",
    HOLE_COLUMNS,
    HOLES
    + "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS name, count(*) - {n} AS missing_count, "
        f"round(100.0::DOUBLE * (count(*) - {n}) / count(*), 6) AS missing_pct FROM holes"
        for c, n in PRESENT.items()
    )
    + ") WHERE missing_count > 0",
)
def missing_report(df: DataFrame) -> DataFrame:
    return neat(profile.missing_report(with_holes(df)).withColumnRenamed("column", "name"))


@on_contacts(
    "completeness",
    HOLE_COLUMNS,
    HOLES
    + "SELECT CAST(5 * count(*) - ("
    + " + ".join(PRESENT.values())
    + ") AS BIGINT) AS missing_total, round(100 - 100.0::DOUBLE * (5 * count(*) - ("
    + " + ".join(PRESENT.values())
    + ")) / (5 * count(*)), 6) AS completeness_pct FROM holes",
)
def completeness(df: DataFrame) -> DataFrame:
    return neat(profile.completeness(with_holes(df)))


@on_contacts(
    "duplicate_count",
    HOLE_COLUMNS,
    HOLES
    + """SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates
  FROM (SELECT count(*) AS n FROM holes GROUP BY gap, outcome, y)""",
)
def duplicate_count(df: DataFrame) -> DataFrame:
    return profile.duplicate_count(with_holes(df).select("gap", "outcome", "y"))


@on_table(
    "duplicate_documents",
    "documents",
    "SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM documents GROUP BY text, lang)",
)
def duplicate_documents(df: DataFrame) -> DataFrame:
    return profile.duplicate_count(df.select("text", "lang"))


@on_contacts(
    "columns_of_kind",
    "id job balance campaign y",
    """SELECT 'balance' AS name, round(avg(balance), 6) AS mean FROM contacts
  UNION ALL SELECT 'campaign', round(avg(campaign), 6) FROM contacts""",
)
def columns_of_kind(df: DataFrame) -> DataFrame:
    numeric = [c for c in profile.columns_of_kind(df, "numeric") if c != "id"]
    means = rates.group_means(df.withColumn("all", F.lit("all")), "all", numeric)
    return neat(profile.transpose_summary(means, "all", numeric).select(F.col("measure").alias("name"), F.col("value").alias("mean")))


@on_contacts("select_drop", ALL, "SELECT * EXCLUDE (y, client) FROM contacts")
def select_drop(df: DataFrame) -> DataFrame:
    return df.drop("y", "client")


@on_contacts("class_filter", ALL, "SELECT id, balance, duration FROM contacts WHERE y = 'yes'")
def class_filter(df: DataFrame) -> DataFrame:
    return df.filter(F.col("y") == "yes").select("id", "balance", "duration")


@on_contacts("open_interval", "id balance y", "SELECT * FROM (SELECT id, balance, y FROM contacts) WHERE balance > -500 AND balance < 8000")
def open_interval(df: DataFrame) -> DataFrame:
    return profile.between_open(df, "balance", -500, 8000)


@on_contacts(
    "predicate_share",
    "balance previous marital",
    """SELECT 'overdrawn' AS predicate, count(*) FILTER (balance < 0) AS n,
    round(100.0::DOUBLE * count(*) FILTER (balance < 0) / count(*), 6) AS pct FROM contacts
  UNION ALL SELECT 'first contact', count(*) FILTER (previous = 0),
    round(100.0::DOUBLE * count(*) FILTER (previous = 0) / count(*), 6) FROM contacts
  UNION ALL SELECT 'status F', count(*) FILTER (marital = 'F'),
    round(100.0::DOUBLE * count(*) FILTER (marital = 'F') / count(*), 6) FROM contacts""",
)
def predicate_share(df: DataFrame) -> DataFrame:
    tests = {
        "overdrawn": F.col("balance") < 0,
        "first contact": F.col("previous") == 0,
        "status F": F.col("marital") == "F",
    }
    return neat(profile.share_where(df, tests).withColumnRenamed("rows", "n"))


@query(
    "rates_above_zero",
    """SELECT doc_source AS level, round(100.0::DOUBLE * toxic / n, 6) AS rate FROM (
    SELECT source AS doc_source, count(*) AS n, count(*) FILTER (l.toxic = 1) AS toxic
    FROM documents d JOIN labels l USING (doc_id) GROUP BY source) WHERE toxic > 0""",
)
def rates_above_zero(spark: SparkSession, directory: str) -> DataFrame:
    docs = read_table(spark, directory, "documents").select("doc_id", "source")
    labelled = docs.join(read_table(spark, directory, "labels"), "doc_id")
    found = rates.response_rate(labelled.withColumn("t", F.col("toxic").cast("string")), "source", "t", "1")
    return neat(found.filter(F.col("rate") > 0).select("level", "rate"))


@on_contacts("distinct_levels", "contact", "SELECT DISTINCT contact FROM contacts")
def distinct_levels(df: DataFrame) -> DataFrame:
    return profile.distinct_levels(df, "contact")


@on_contacts(
    "renamed_rates",
    "day y",
    """SELECT day AS "Day", round(avg(CASE WHEN y = 'yes' THEN 100.0::DOUBLE ELSE 0 END), 6) AS "Response Rate (%)"
  FROM contacts GROUP BY day""",
)
def renamed_rates(df: DataFrame) -> DataFrame:
    return neat(rates.response_rate(df, "day").select("level", "rate").toDF("Day", "Response Rate (%)"))


@query(
    "subset_by_keys",
    CONTACTS
    + """SELECT id, client, balance FROM contacts
  WHERE client IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 400000)""",
)
def subset_by_keys(spark: SparkSession, directory: str) -> DataFrame:
    orders = read_table(spark, directory, "orders")
    keys = orders.filter((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 400000))
    return prep.subset_by_keys(
        contacts(spark, directory, ["id", "client", "balance"]), keys.select(F.col("o_custkey").alias("client")), "client"
    ).select("id", "client", "balance")


@on_contacts(
    "transposed_means",
    "job balance duration campaign",
    """SELECT m AS measure, job, round(v, 6) AS value FROM (
    SELECT 'balance' AS m, job, avg(balance) AS v FROM contacts GROUP BY job
    UNION ALL SELECT 'duration', job, avg(duration) FROM contacts GROUP BY job
    UNION ALL SELECT 'campaign', job, avg(campaign) FROM contacts GROUP BY job)""",
)
def transposed_means(df: DataFrame) -> DataFrame:
    cols = ["balance", "duration", "campaign"]
    return neat(profile.transpose_summary(rates.group_means(df, "job", cols), "job", cols))


@on_contacts(
    "with_bins",
    "id balance campaign",
    """SELECT id, balance, campaign,
    CASE WHEN balance <= 0 THEN 'Negative' WHEN balance <= 500 THEN 'Low' WHEN balance <= 2000 THEN 'Medium' ELSE 'High' END AS balance_bin,
    CASE WHEN campaign <= 0 THEN NULL WHEN campaign <= 1 THEN '1' WHEN campaign <= 2 THEN '2' WHEN campaign <= 3 THEN '3'
         WHEN campaign <= 5 THEN '4-5' WHEN campaign <= 100 THEN '6+' END AS campaign_bin
  FROM contacts""",
)
def with_bins(df: DataFrame) -> DataFrame:
    return df.withColumn("balance_bin", S.cut("balance", BALANCE_EDGES, BALANCE_LABELS)).withColumn(
        "campaign_bin", S.cut("campaign", CAMPAIGN_EDGES, CAMPAIGN_LABELS)
    )


@on_contacts(
    "union_of_parts",
    "id y",
    """SELECT id, y FROM contacts WHERE y = 'yes' UNION ALL
  SELECT id, y FROM (SELECT id, y FROM contacts WHERE y = 'no' ORDER BY md5('7:' || id) LIMIT 1000)""",
)
def union_of_parts(df: DataFrame) -> DataFrame:
    drawn = profile.sample_exact(df.filter(F.col("y") == "no"), 1000, "id", seed=7)
    return df.filter(F.col("y") == "yes").unionByName(drawn)


@on_contacts("seeded_shuffle", "id y", "SELECT id, y FROM contacts ORDER BY md5('42:' || id)")
def seeded_shuffle(df: DataFrame) -> DataFrame:
    return prep.shuffled(df, "id")


@on_contacts("month_filter", "id month balance", "SELECT id, month, balance FROM contacts WHERE month = 'jan'")
def month_filter(df: DataFrame) -> DataFrame:
    return df.filter(F.col("month") == "jan")


@on_contacts(
    "scalar_functions",
    "id y month balance duration campaign contact",
    """SELECT id, CASE y WHEN 'yes' THEN 1::BIGINT WHEN 'no' THEN 0::BIGINT END AS code,
    upper(month) AS month_upper, replace(lower(contact), ' ', '_') AS contact_slug,
    round(duration / 60, 6) AS minutes, round(abs(balance), 2) AS size, contact LIKE '%EAST%' AS east,
    CASE WHEN campaign = 0 THEN NULL ELSE round(duration / campaign, 6) END AS per_line,
    coalesce(CASE WHEN campaign = 0 THEN NULL ELSE round(duration / campaign, 6) END, 0) AS per_line_or_zero,
    round((duration - 250000) / 250000 * 100, 6) AS change_pct,
    round(sign(balance) * ln(1 + abs(balance)), 6) AS log_balance
  FROM contacts""",
)
def scalar_functions(df: DataFrame) -> DataFrame:
    per_line = F.round(S.ratio(F.col("duration"), F.col("campaign")), 6)
    return df.select(
        "id",
        S.yes_no("y").cast("long").alias("code"),
        F.upper("month").alias("month_upper"),
        S.slug("contact").alias("contact_slug"),
        F.round(F.col("duration") / 60, 6).alias("minutes"),
        F.round(F.abs("balance"), 2).alias("size"),
        F.col("contact").contains("EAST").alias("east"),
        per_line.alias("per_line"),
        S.or_zero(per_line).alias("per_line_or_zero"),
        F.round(S.relative_change(F.col("duration"), F.lit(250000.0)), 6).alias("change_pct"),
        F.round(S.signed_log("balance"), 6).alias("log_balance"),
    )
