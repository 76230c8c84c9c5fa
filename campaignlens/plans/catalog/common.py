"""Registration, shared SQL and shared inputs of the catalog."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from campaignlens.plans.contacts import contacts
from campaignlens.session import written
from campaignlens.sources.readers import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The contact view in SQL, as the head of a WITH list.
CONTACTS = """
WITH line_counts AS (
  SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY l_orderkey),
history AS (
  SELECT o_orderkey AS h_key,
         row_number() OVER w - 1 AS previous,
         lag(o_orderdate) OVER w AS prior_date,
         lag(o_orderstatus) OVER w AS prior_status
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
contacts AS (
  SELECT o_orderkey AS id, o_custkey AS client, c_mktsegment AS job, o_orderstatus AS marital,
         r_name AS contact, CAST(c_nationkey AS BIGINT) AS nation_key, c_acctbal AS balance,
         o_totalprice AS duration, CAST(coalesce(lines, 0) AS BIGINT) AS campaign,
         CAST(day(o_orderdate) AS BIGINT) AS day, lower(strftime(o_orderdate, '%b')) AS month,
         CAST(previous AS BIGINT) AS previous,
         CAST(coalesce(date_diff('day', CAST(prior_date AS DATE), CAST(o_orderdate AS DATE)), -1) AS BIGINT) AS pdays,
         CASE WHEN previous = 0 THEN 'unknown' ELSE prior_status END AS poutcome,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'yes' ELSE 'no' END AS y
  FROM orders
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  JOIN history ON h_key = o_orderkey
  LEFT JOIN line_counts ON l_orderkey = o_orderkey)
"""


def query(name: str, sql: str | None = None):
    """Registers a query; ``sql`` is its full equivalent, None for a rows-only check."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def on_contacts(name: str, columns: str, sql: str | None = None):
    """Registers a query over the named columns of the contact view."""

    def register(f: Callable[[DataFrame], DataFrame]):
        def run(spark: SparkSession, directory: str) -> DataFrame:
            return f(contacts(spark, directory, columns.split()))

        query(name, None if sql is None else CONTACTS + sql)(run)
        return f

    return register


def on_table(name: str, table: str, sql: str | None = None):
    """Registers a query over one table."""

    def register(f: Callable[[DataFrame], DataFrame]):
        def run(spark: SparkSession, directory: str) -> DataFrame:
            return f(read_table(spark, directory, table))

        query(name, sql)(run)
        return f

    return register


def neat(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison, other numbers as long."""
    out = []
    for c, t in df.dtypes:
        if t in ("double", "float"):
            out.append((F.round(F.col(c).cast("double"), digits) + F.lit(0.0)).alias(c))
        elif t in ("int", "smallint", "tinyint"):
            out.append(F.col(c).cast("long").alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def placed(df: DataFrame) -> DataFrame:
    """Adds ``pos``, where each row stands in the frame as it comes out: from 1, part after part."""
    rows = written(df.withColumns({"part": F.spark_partition_id(), "nth": F.monotonically_increasing_id()}), "placed")
    # One row per part of the frame.
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy("part").agg(F.count("*").alias("n"), F.min("nth").alias("first"))
    starts = starts.select("part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return rows.join(starts, "part").select(*df.columns, (F.col("nth") - F.col("first") + F.col("start") + 1).alias("pos"))


def with_score(df: DataFrame) -> DataFrame:
    """A fixed score from the balance, with ties, and the matching 0/1 columns."""
    score = F.round((F.col("balance") + 1000) / 11000, 3)
    return df.select(
        "id",
        score.alias("score"),
        F.when(F.col("y") == "yes", 1).otherwise(0).alias("label"),
        F.when(score >= 0.5, 1).otherwise(0).alias("prediction"),
    )


# The same frame in SQL, after CONTACTS.
SCORED = """,
scored AS (
  SELECT id, round((balance + 1000) / 11000, 3) AS score,
         CASE WHEN y = 'yes' THEN 1 ELSE 0 END AS label,
         CASE WHEN round((balance + 1000) / 11000, 3) >= 0.5 THEN 1 ELSE 0 END AS prediction
  FROM contacts)
"""


def on_scored(name: str, sql: str | None = None):
    """Registers a query over the contact rows with the fixed score."""

    def register(f: Callable[[DataFrame], DataFrame]):
        def run(spark: SparkSession, directory: str) -> DataFrame:
            return f(with_score(contacts(spark, directory, ["id", "balance", "y"])))

        query(name, None if sql is None else CONTACTS + SCORED + sql)(run)
        return f

    return register
