"""Response rate over time, as a batch table and as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from campaignlens.functions.scalars import indicator
from campaignlens.functions.times import instant, utc_clock


def response_by_window(
    events: DataFrame, ts: str, positive: Column, width: str = "1 day", late: str | None = None
) -> DataFrame:
    """Rows, responses and rate per tumbling window, for a batch or a streaming frame.

    ``late`` sets the watermark of a stream: how long a window waits for late rows.
    """
    timed = events.select(instant(ts, dict(events.dtypes)[ts]).alias("at"), positive.alias("hit"))
    if late is not None:
        timed = timed.withWatermark("at", late)
    hit = F.coalesce(F.col("hit"), F.lit(False))
    return (
        timed.groupBy(F.window("at", width).alias("w"))
        .agg(
            F.count("*").alias("rows"),
            F.count(F.when(hit, 1)).alias("responses"),
            (F.avg(indicator(hit)) * 100).alias("rate"),
        )
        .select(utc_clock("w.start").alias("window_start"), "rows", "responses", "rate")
    )


def write_arrivals(events: DataFrame, ts: str, positive: Column, path: str, checkpoint: str, width: str = "1 day") -> None:
    """Runs the stream over everything available and writes rows and responses per window of each batch.

    A ledger of all that arrived, however late: no state and no watermark, so nothing is left
    out. A batch that is run again replaces its folder. Rows without a time are in no window,
    here as in :func:`response_by_window`.
    """

    def count(batch: DataFrame) -> DataFrame:
        return response_by_window(batch, ts, positive, width).drop("rate")

    _write_batches(events, path, checkpoint, count)


def late_rows(updates: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Per window what the stream reported, what arrived behind its watermark, and both together.

    ``updates`` are the batches of :func:`write_updates`, ``arrivals`` those of
    :func:`write_arrivals` over the same files. ``late_rows`` and ``late_responses`` are the
    corrections: rows that the stream dropped since their window was closed. A window of late
    rows alone has nothing reported. ``rate`` is that of all rows. Read both sides when their
    streams have seen the same files; before, a difference is also work in progress.
    """
    all_rows = arrivals.groupBy("window_start").agg(F.sum("rows").alias("rows"), F.sum("responses").alias("responses"))
    counts = [F.coalesce(F.col(c), F.lit(0)).alias(f"reported_{c}") for c in ("rows", "responses")]
    reported = latest_windows(updates).select("window_start", *counts)
    both = all_rows.join(reported, "window_start", "left").na.fill(0, ["reported_rows", "reported_responses"])
    return both.select(
        "window_start",
        "reported_rows",
        "reported_responses",
        (F.col("rows") - F.col("reported_rows")).alias("late_rows"),
        (F.col("responses") - F.col("reported_responses")).alias("late_responses"),
        "rows",
        "responses",
        (F.col("responses") * 100 / F.col("rows")).alias("rate"),
    )


def stream_table(spark: SparkSession, directory: str, pattern: str = "*.parquet", per_batch: int = 1000) -> DataFrame:
    """Parquet files of a folder as a stream, oldest first, with the schema of the files there now."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(directory).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_batch)
    return reader.parquet(directory)


def _write_batches(
    stream: DataFrame, path: str, checkpoint: str, change: Callable[[DataFrame], DataFrame], mode: str = "append"
) -> None:
    """Runs the stream over everything available; each changed batch replaces its own folder."""

    def put(batch: DataFrame, number: int) -> None:
        change(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(put)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def write_updates(windows: DataFrame, path: str, checkpoint: str) -> None:
    """Runs the stream over everything available and writes each batch's changed windows to its own folder.

    A batch that is run again after a failure replaces its folder, so nothing counts twice.
    """
    _write_batches(windows, path, checkpoint, lambda batch: batch, "update")


def read_batches(spark: SparkSession, path: str, fields: T.StructType) -> DataFrame:
    """The batches written below ``path``, with their number in ``batch``; no rows where there are none."""
    schema = T.StructType([*fields.fields, T.StructField("batch", T.IntegerType())])
    return spark.read.schema(schema).parquet(path)


def latest_windows(updates: DataFrame) -> DataFrame:
    """The last state of every window, open ones too, from the written batches."""
    fields = [c for c in updates.columns if c not in ("batch", "window_start")]
    last = F.max(F.struct("batch", *fields)).alias("last")
    return updates.groupBy("window_start").agg(last).select("window_start", *[f"last.{c}" for c in fields])


def write_windows(windows: DataFrame, path: str, checkpoint: str) -> None:
    """Runs the stream over everything available and appends the closed windows.

    Restarting with the same checkpoint continues where the last run ended.
    """
    query = (
        windows.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
