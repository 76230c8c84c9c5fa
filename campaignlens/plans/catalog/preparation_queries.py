"""Encoding, balancing, splitting, scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campaignlens.functions.scalars import yes_no
from campaignlens.operators import prep
from campaignlens.operators.profile import conditional_total
from campaignlens.plans.catalog.common import neat, on_contacts
from campaignlens.session import written

CATEGORICAL = ["job", "marital", "contact", "month", "poutcome"]
NUMERIC = ["balance", "duration", "campaign"]

DICTIONARY = " UNION ALL ".join(
    f"SELECT '{c}' AS name, level, row_number() OVER (ORDER BY level) - 1 AS code FROM (SELECT DISTINCT {c} AS level FROM contacts)"
    for c in CATEGORICAL
)


@on_contacts("label_dictionary", " ".join(CATEGORICAL), DICTIONARY)
def label_dictionary(df: DataFrame) -> DataFrame:
    return neat(prep.fit_label_dictionary(df, CATEGORICAL).withColumnRenamed("column", "name"))


@on_contacts(
    "encode",
    "id " + " ".join(CATEGORICAL),
    "SELECT id, " + ", ".join(f"dense_rank() OVER (ORDER BY {c}) - 1 AS {c}" for c in CATEGORICAL) + " FROM contacts",
)
def encode(df: DataFrame) -> DataFrame:
    return neat(prep.encode(df, prep.fit_label_dictionary(df, CATEGORICAL), CATEGORICAL, strict=True))


@on_contacts("decode", "id " + " ".join(CATEGORICAL), f"SELECT id, {', '.join(CATEGORICAL)} FROM contacts")
def decode(df: DataFrame) -> DataFrame:
    dictionary = prep.fit_label_dictionary(df, CATEGORICAL)
    return prep.decode(prep.encode(df, dictionary, CATEGORICAL), dictionary, CATEGORICAL)


@on_contacts("encode_target", "id y", "SELECT id, CASE WHEN y = 'yes' THEN 1 ELSE 0 END::BIGINT AS label FROM contacts")
def encode_target(df: DataFrame) -> DataFrame:
    return neat(df.select("id", yes_no("y").alias("label")))


@on_contacts(
    "class_distribution",
    "y",
    """SELECT y AS level, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM contacts), 6) AS pct,
  round((SELECT count(*) FROM contacts WHERE y = 'no')::DOUBLE / (SELECT count(*) FROM contacts WHERE y = 'yes'), 6) AS imbalance
  FROM contacts GROUP BY y""",
)
def class_distribution(df: DataFrame) -> DataFrame:
    return neat(prep.class_distribution(df, "y").withColumnRenamed("rows", "n"))


BALANCED = """, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('42:' || id)) AS seat FROM contacts),
balanced AS (
  SELECT * EXCLUDE (seat) FROM ranked
  WHERE seat <= (SELECT min(n) FROM (SELECT count(*) AS n FROM contacts GROUP BY y)))
"""


@on_contacts("undersample", "id y balance", BALANCED + "SELECT id, y, balance FROM balanced")
def undersample(df: DataFrame) -> DataFrame:
    return prep.undersample(df, "y", "id")


@on_contacts(
    "undersample_three_classes",
    "id marital",
    """, r AS (SELECT id, marital, row_number() OVER (PARTITION BY marital ORDER BY md5('42:' || id)) AS seat FROM contacts)
  SELECT id, marital FROM r WHERE seat <= (SELECT min(n) FROM (SELECT count(*) AS n FROM contacts GROUP BY marital))""",
)
def undersample_three(df: DataFrame) -> DataFrame:
    return prep.undersample(df, "marital", "id")


SPLIT = """, sizes AS (
  SELECT y, count(*) AS n, count(*) * ceil(0.2 * sum(count(*)) OVER ()) / sum(count(*)) OVER () AS want,
         ceil(0.2 * sum(count(*)) OVER ()) AS goal FROM contacts GROUP BY y),
takes AS (
  SELECT y, floor(want) + CASE WHEN row_number() OVER (ORDER BY want - floor(want) DESC, y)
           <= goal - sum(floor(want)) OVER () THEN 1 ELSE 0 END AS take FROM sizes),
split AS (
  SELECT c.*, CASE WHEN row_number() OVER (PARTITION BY c.y ORDER BY md5('42:' || id)) <= take
                   THEN 'test' ELSE 'train' END AS split FROM contacts c JOIN takes t ON c.y = t.y)
"""


@on_contacts("stratified_split", "id y", SPLIT + "SELECT id, y, split FROM split")
def stratified_split(df: DataFrame) -> DataFrame:
    return prep.stratified_split(df, "y", "id")


@on_contacts(
    "split_with_missing_labels",
    "id poutcome",
    """, known AS (SELECT id, poutcome AS y FROM contacts WHERE poutcome <> 'unknown'),
sizes AS (
  SELECT y, count(*) * ceil(0.2 * sum(count(*)) OVER ()) / sum(count(*)) OVER () AS want,
         ceil(0.2 * sum(count(*)) OVER ()) AS goal FROM known GROUP BY y),
takes AS (
  SELECT y, floor(want) + CASE WHEN row_number() OVER (ORDER BY want - floor(want) DESC, y)
           <= goal - sum(floor(want)) OVER () THEN 1 ELSE 0 END AS take FROM sizes),
parts AS (
  SELECT k.id, CASE WHEN row_number() OVER (PARTITION BY k.y ORDER BY md5('42:' || id)) <= take
                    THEN 'test' ELSE 'train' END AS split FROM known k JOIN takes t ON k.y = t.y)
  SELECT c.id, split FROM contacts c LEFT JOIN parts USING (id)""",
)
def split_with_missing_labels(df: DataFrame) -> DataFrame:
    labelled = df.select("id", F.when(F.col("poutcome") != "unknown", F.col("poutcome")).alias("y"))
    return prep.stratified_split(labelled, "y", "id").select("id", "split")


@on_contacts(
    "split_sizes",
    "id y",
    SPLIT
    + """SELECT split, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM contacts), 6) AS pct
  FROM split GROUP BY split""",
)
def split_sizes(df: DataFrame) -> DataFrame:
    return neat(prep.split_sizes(prep.stratified_split(df, "y", "id")).withColumnRenamed("rows", "n"))


SCALED = "SELECT id, " + ", ".join(
    f"round(({c} - avg({c}) FILTER (split = 'train') OVER ()) / stddev_pop({c}) FILTER (split = 'train') OVER (), 6) + 0.0 AS {c}"
    for c in NUMERIC
)


@on_contacts("standardize", "id y " + " ".join(NUMERIC), SPLIT + SCALED + ", split FROM split")
def standardize(df: DataFrame) -> DataFrame:
    parts = written(prep.stratified_split(df, "y", "id"), "parts")
    (scaled,) = prep.standardize(parts.filter(F.col("split") == "train"), [parts], NUMERIC)[1:]
    return neat(scaled.select("id", *NUMERIC, "split"))


@on_contacts(
    "scaling_check",
    " ".join(NUMERIC),
    " UNION ALL ".join(
        f"""SELECT 'before' AS stage, '{c}' AS name, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std FROM contacts
  UNION ALL SELECT 'after', '{c}', 0.0::DOUBLE, round(stddev_samp({c}) / stddev_pop({c}), 4) FROM contacts"""
        for c in NUMERIC
    ),
)
def scaling_check(df: DataFrame) -> DataFrame:
    (after,) = prep.standardize(df, [], NUMERIC)
    return neat(prep.scaling_check(df, after, NUMERIC).withColumnRenamed("column", "name"), 4)


@on_contacts(
    "contacted_before",
    "id pdays",
    "SELECT id, pdays, CASE WHEN pdays <> -1 THEN 1 ELSE 0 END::BIGINT AS contacted_before FROM contacts",
)
def contacted_before(df: DataFrame) -> DataFrame:
    return prep.contacted_before(df)


@on_contacts(
    "log_columns",
    "id balance duration",
    """SELECT id, round(sign(balance) * ln(1 + abs(balance)), 6) AS balance, round(ln(1 + duration), 6) AS duration
  FROM contacts""",
)
def log_columns(df: DataFrame) -> DataFrame:
    return neat(prep.log_columns(df, ["balance", "duration"]))


@on_contacts(
    "one_hot",
    "id marital",
    "SELECT id, marital, "
    + ", ".join(f"CASE WHEN marital = '{v}' THEN 1 ELSE 0 END::BIGINT AS marital_{v}" for v in "FOP")
    + " FROM contacts",
)
def one_hot(df: DataFrame) -> DataFrame:
    return prep.one_hot(df, "marital", ["F", "O", "P"])


@on_contacts(
    "min_max",
    "id balance duration",
    "SELECT id, "
    + ", ".join(
        f"round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()), 6) AS {c}" for c in ("balance", "duration")
    )
    + " FROM contacts",
)
def min_max(df: DataFrame) -> DataFrame:
    return neat(prep.min_max(df, ["balance", "duration"]))


@on_contacts(
    "class_weights",
    "id y",
    """SELECT id, y, round(count(*) OVER () / (2.0::DOUBLE * count(*) OVER (PARTITION BY y)), 6) AS weight FROM contacts""",
)
def class_weights(df: DataFrame) -> DataFrame:
    return neat(prep.class_weights(df, "y"))


@on_contacts(
    "balanced_totals",
    "id y",
    BALANCED
    + "SELECT count(*) FILTER (y = 'yes') AS positive, count(*) FILTER (y <> 'yes') AS rest, count(*) AS total FROM balanced",
)
def balanced_totals(df: DataFrame) -> DataFrame:
    return conditional_total(prep.undersample(df, "y", "id"), "y")
