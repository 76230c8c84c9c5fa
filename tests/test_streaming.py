"""Rows behind the watermark: counted, corrected, and the same after a batch is run again."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from campaignlens.streaming.monitor import late_rows, read_batches, response_by_window, stream_table, write_arrivals, write_updates


def run(spark, folder, rows, state):
    """Rows arrive in one file; streams with the memory ``state`` read what is new in that memory's folder."""
    source, hit = f"{folder}/in-{state}", F.col("kind") == "buy"
    spark.createDataFrame(rows, "ts timestamp, kind string").coalesce(1).write.mode("append").parquet(source)
    windows = response_by_window(stream_table(spark, source), "ts", hit, late="1 hour")
    write_updates(windows, f"{folder}/updates", f"{folder}/{state}-updates")
    write_arrivals(stream_table(spark, source), "ts", hit, f"{folder}/ledger", f"{folder}/{state}-ledger")
    updates = read_batches(spark, f"{folder}/updates", windows.schema)
    ledger = read_batches(spark, f"{folder}/ledger", windows.drop("rate").schema)
    table = late_rows(updates, ledger).orderBy("window_start").collect()
    return [(r["reported_rows"], r["late_rows"], r["late_responses"], r["rows"], r["responses"], round(r["rate"], 6)) for r in table]


def test_late_rows_are_counted_and_corrected(spark, tmp_path):
    folder = str(tmp_path / "late")

    def at(day, hour, kind="look"):
        return (datetime(2024, 1, day, hour), kind)

    assert run(spark, folder, [at(2, 5), at(2, 6, "buy"), (None, "buy")], "a") == [(2, 0, 0, 2, 1, 50.0)]
    assert run(spark, folder, [at(5, 9), at(2, 7)], "a")[0] == (3, 0, 0, 3, 1, 33.333333)
    # Day 2 is closed now; day 1 was never open; day 5 still is.
    rows = run(spark, folder, [at(2, 8, "buy"), at(1, 3, "buy"), at(1, 4, None), at(5, 1, "buy")], "a")
    assert rows == [(0, 2, 1, 2, 1, 50.0), (3, 1, 1, 4, 2, 50.0), (2, 0, 0, 2, 1, 50.0)]


def test_a_ledger_written_again_counts_once(spark, tmp_path):
    folder = str(tmp_path / "again")
    rows = [(datetime(2024, 1, 2, 5), "buy"), (datetime(2024, 1, 2, 6), "look")]
    first = run(spark, folder, rows, "a")
    # The streams lose their memory and read the same rows anew: batch 0 replaces batch 0.
    assert run(spark, folder, rows, "b") == first
