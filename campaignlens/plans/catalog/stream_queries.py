"""Response over time, as a batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from campaignlens.functions.times import instant
from campaignlens.plans.catalog.common import neat, on_table, query
from campaignlens.session import shared_dir
from campaignlens.sources.readers import read_table
from campaignlens.streaming.monitor import (
    late_rows,
    latest_windows,
    read_batches,
    response_by_window,
    stream_table,
    write_arrivals,
    write_updates,
)

DAYS = """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n,
    count(*) FILTER (event_type = 'purchase') AS responses,
    round(100.0::DOUBLE * count(*) FILTER (event_type = 'purchase') / count(*), 6) AS rate
  FROM events GROUP BY 1"""


def plain(df: DataFrame) -> DataFrame:
    day = F.date_format(F.col("window_start").cast("date"), "yyyy-MM-dd").alias("day")
    return neat(df.select(day, F.col("rows").alias("n"), "responses", "rate"))


@on_table("response_over_time", "events", DAYS)
def response_over_time(df: DataFrame) -> DataFrame:
    return plain(response_by_window(df, "ts", F.col("event_type") == "purchase"))


def thirds(spark: SparkSession, directory: str) -> tuple[DataFrame, str]:
    """The events, and a folder with each third of their time range in as many files as it has."""
    events = read_table(spark, directory, "events")
    at = F.unix_micros(instant("ts", dict(events.dtypes)["ts"]))
    first, last = events.agg(F.min(at), F.max(at)).first()
    third = F.floor((at - F.lit(first)) * 3 / F.lit(max(1, last - first + 1)))
    parts = shared_dir(spark, "event-parts")
    events.withColumn("third", third).write.partitionBy("third").parquet(parts)
    return events, parts


def arrive(events: DataFrame, parts: str, part: int, arrived: str) -> None:
    events.sparkSession.read.schema(events.schema).parquet(f"{parts}/third={part}").write.mode("append").parquet(arrived)


@query("response_over_time_stream", DAYS)
def response_over_time_stream(spark: SparkSession, directory: str) -> DataFrame:
    """Every day, the still open last one too, from a stream with one hour of patience.

    The events arrive in three parts in the order of time, each of as many files as it has;
    the stream runs once per part with one checkpoint, so that the watermark moves and states
    are closed between the runs.
    """
    events, parts = thirds(spark, directory)
    arrived, path, checkpoint = (shared_dir(spark, n) for n in ("events", "windows", "windows-checkpoint"))
    for part in range(3):
        arrive(events, parts, part, arrived)
        windows = response_by_window(stream_table(spark, arrived), "ts", F.col("event_type") == "purchase", late="1 hour")
        write_updates(windows, path, checkpoint)
    return plain(latest_windows(read_batches(spark, path, windows.schema)))


@query(
    "response_with_late_rows",
    """WITH marked AS (
    SELECT *, epoch_us(ts) AS us, min(epoch_us(ts)) OVER () AS low, max(epoch_us(ts)) OVER () AS high FROM events),
  placed AS (
    SELECT *, floor((us - low) * 3 / greatest(1, high - low + 1)::DOUBLE) = 1
        AND epoch_us(date_trunc('day', ts)) + 86400000000 <= high - 3600000000 AS is_late FROM marked)
  SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) FILTER (NOT is_late) AS reported,
    count(*) FILTER (is_late) AS late, count(*) FILTER (is_late AND event_type = 'purchase') AS late_responses,
    count(*) AS n, count(*) FILTER (event_type = 'purchase') AS responses,
    round(100.0::DOUBLE * count(*) FILTER (event_type = 'purchase') / count(*), 6) AS rate
  FROM placed GROUP BY 1""",
)
def response_with_late_rows(spark: SparkSession, directory: str) -> DataFrame:
    """The middle third of the events arrives last, behind the watermark: stream and corrections are the batch.

    Late is what lies in a day that ended an hour or more before the newest event.
    """
    events, parts = thirds(spark, directory)
    arrived, path, checkpoint = (shared_dir(spark, n) for n in ("events", "windows", "windows-checkpoint"))
    ledger, ledger_checkpoint = shared_dir(spark, "arrivals"), shared_dir(spark, "arrivals-checkpoint")
    hit = F.col("event_type") == "purchase"
    for part in (0, 2, 1):
        arrive(events, parts, part, arrived)
        windows = response_by_window(stream_table(spark, arrived), "ts", hit, late="1 hour")
        write_updates(windows, path, checkpoint)
        write_arrivals(stream_table(spark, arrived), "ts", hit, ledger, ledger_checkpoint)
    updates = read_batches(spark, path, windows.schema)
    whole = late_rows(updates, read_batches(spark, ledger, windows.drop("rate").schema))
    day = F.date_format(F.col("window_start").cast("date"), "yyyy-MM-dd").alias("day")
    return neat(
        whole.select(
            day, F.col("reported_rows").alias("reported"), F.col("late_rows").alias("late"), "late_responses",
            F.col("rows").alias("n"), "responses", "rate",
        )
    )
