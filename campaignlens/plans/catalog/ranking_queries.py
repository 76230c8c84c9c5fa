"""Sorted reports, cumulative shares, ranked prospects, contact history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from campaignlens.operators import ranking
from campaignlens.operators.history import with_history
from campaignlens.plans.catalog.common import neat, on_contacts, on_scored, on_table, placed, query
from campaignlens.sources.readers import read_table

REVENUE = """WITH parts AS (SELECT l_partkey, round(sum(l_extendedprice), 2) AS revenue FROM lineitem GROUP BY l_partkey),
shares AS (SELECT *, row_number() OVER w AS pos, sum(revenue) OVER (w ROWS UNBOUNDED PRECEDING) AS cumulative,
    sum(revenue) OVER (w ROWS UNBOUNDED PRECEDING) / sum(revenue) OVER () AS share
  FROM parts WINDOW w AS (ORDER BY revenue DESC, md5('0:' || l_partkey)))
"""


def part_revenue(df: DataFrame) -> DataFrame:
    return df.groupBy("l_partkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue"))


@on_table(
    "cumulative_share",
    "lineitem",
    REVENUE + "SELECT l_partkey, revenue, pos, round(cumulative, 2) AS cumulative, round(share, 6) AS share FROM shares",
)
def cumulative_share(df: DataFrame) -> DataFrame:
    out = ranking.cumulative_share(part_revenue(df), "l_partkey", "revenue")
    out = out.withColumn("cumulative", F.round("cumulative", 2)).withColumnRenamed("position", "pos")
    return neat(out)


@on_table(
    "rows_to_reach",
    "lineitem",
    REVENUE
    + """SELECT 0.8::DOUBLE AS threshold, count(*) FILTER (share <= 0.8) + 1 AS n FROM shares
  UNION ALL SELECT 0.9::DOUBLE, count(*) FILTER (share <= 0.9) + 1 FROM shares""",
)
def rows_to_reach(df: DataFrame) -> DataFrame:
    shares = ranking.cumulative_share(part_revenue(df), "l_partkey", "revenue")
    return neat(ranking.rows_to_reach(shares, [0.8, 0.9]).withColumnRenamed("rows", "n"))


@on_scored(
    "rank_prospects",
    """SELECT id, score, row_number() OVER (ORDER BY score DESC, md5('0:' || id)) AS pos,
    round(percent_rank() OVER (ORDER BY score DESC), 6) AS percent_rank,
    ntile(7) OVER (ORDER BY score DESC, md5('0:' || id)) AS tile FROM scored""",
)
def rank_prospects(df: DataFrame) -> DataFrame:
    return neat(ranking.rank_prospects(df, "score", "id", tiles=7).withColumnRenamed("position", "pos"))


@on_scored(
    "top_share",
    """SELECT id, score, pos FROM (
    SELECT id, score, row_number() OVER (ORDER BY score DESC, md5('0:' || id)) AS pos, count(*) OVER () AS n FROM scored)
  WHERE pos <= ceil(n * 0.3)""",
)
def top_share(df: DataFrame) -> DataFrame:
    return neat(ranking.top_share(df, "score", "id", 0.3).withColumnRenamed("position", "pos"))


@on_scored(
    "choose_share",
    """SELECT id, score FROM (
    SELECT id, score, row_number() OVER (ORDER BY score DESC, md5('0:' || id)) AS pos, count(*) OVER () AS n FROM scored)
  WHERE pos <= ceil(n * 0.3)""",
)
def choose_share(df: DataFrame) -> DataFrame:
    return ranking.choose_share(df, "score", "id", 0.3)


@on_contacts("sort_by_measure", "id balance", "SELECT id, balance, row_number() OVER (ORDER BY balance DESC, id) AS pos FROM contacts")
def sort_by_measure(df: DataFrame) -> DataFrame:
    return placed(ranking.sort_by(df, "balance", "id"))


@on_contacts("sort_by_size", "id balance", "SELECT id, balance, row_number() OVER (ORDER BY abs(balance) DESC, id) AS pos FROM contacts")
def sort_by_size(df: DataFrame) -> DataFrame:
    return placed(ranking.sort_by_size(df, "balance", "id"))


@on_contacts("top_rows", "id duration", "SELECT id, duration FROM contacts ORDER BY duration DESC, id LIMIT 15")
def top_rows(df: DataFrame) -> DataFrame:
    return ranking.top(df, "duration", "id", 15)


@on_contacts("bottom_rows", "id duration", "SELECT id, duration FROM contacts ORDER BY duration, id LIMIT 5")
def bottom_rows(df: DataFrame) -> DataFrame:
    return ranking.bottom(df, "duration", "id", 5)


HISTORY = """SELECT event_id, row_number() OVER w - 1 AS previous,
    coalesce(date_diff('day', lag(ts) OVER w, ts), -1) AS pdays,
    coalesce(lag(event_type) OVER w, 'unknown') AS poutcome
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""


@query("contact_history", HISTORY)
def contact_history(spark: SparkSession, directory: str) -> DataFrame:
    events = read_table(spark, directory, "events").select("event_id", "user_id", "ts", "event_type")
    out = with_history(events, "user_id", "ts", "event_id", "event_type")
    return out.select("event_id", "previous", "pdays", "poutcome")


@query("contact_history_hot_clients", HISTORY)
def contact_history_hot(spark: SparkSession, directory: str) -> DataFrame:
    """The same with every client of more than 20 rows worked in slices."""
    events = read_table(spark, directory, "events").select("event_id", "user_id", "ts", "event_type")
    out = with_history(events, "user_id", "ts", "event_id", "event_type", hot_rows=20)
    return out.select("event_id", "previous", "pdays", "poutcome")
