from __future__ import annotations

from pyspark.sql import functions as F

from campaignlens.operators import rates
from campaignlens.plans.contacts import contacts
from campaignlens.schema import AGE_EDGES, AGE_LABELS, CONTACT
from campaignlens.session import shared_dir, written
from campaignlens.sources import sinks
from campaignlens.sources.readers import read_contacts
from campaignlens.streaming.monitor import response_by_window, stream_table, write_windows

FILE = """"age";"job";"marital";"education";"default";"balance";"housing";"loan";"contact";"day";"month";"duration";"campaign";"pdays";"previous";"poutcome";"y"
30;"student";"single";"tertiary";"no";0;"no";"no";"cellular";1;"mar";600;1;-1;0;"unknown";"yes"
31;"technician";"married";"secondary";"no";500;"yes";"no";"unknown";5;"may";90;2;-1;0;"unknown";"no"
40;"blue-collar";"married";"primary";"yes";-120;"yes";"yes";"telephone";15;"may";45;6;180;2;"failure";"no"
41;"management";"divorced";"tertiary";"no";2001;"no";"no";"cellular";28;"oct";720;1;92;1;"success";"yes"
60;"retired";"married";"unknown";"no";2000;"no";"no";"cellular";9;"sep";300;3;-1;0;"unknown";"no"
61;"retired";"single";"secondary";"no";9999;"no";"no";"cellular";9;"dec";310;5;60;3;"other";"yes"
"""


def test_declared_and_inferred_schema_agree(spark, tmp_path):
    path = tmp_path / "contacts.csv"
    path.write_text(FILE)
    declared = read_contacts(spark, str(path))
    inferred = read_contacts(spark, str(path), schema=None)
    assert declared.schema == CONTACT and inferred.dtypes == declared.dtypes
    assert declared.collect() == inferred.collect() and declared.count() == 6
    assert declared.head()["job"] == "student"


def test_age_bins_at_their_edges(spark, tmp_path):
    path = tmp_path / "contacts.csv"
    path.write_text(FILE)
    got = rates.response_rate_binned(read_contacts(spark, str(path)), "age", AGE_EDGES, AGE_LABELS).collect()
    assert [(r["bin"], r["rows"], r["rate"]) for r in got] == [
        ("<30", 1, 100.0), ("30-39", 2, 0.0), ("40-49", 1, 100.0), ("50-59", 1, 0.0), ("60+", 1, 100.0)]


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert shared_dir(spark, "x") != shared_dir(spark, "x")
    df = written(spark.range(5), "five")
    assert df.count() == 5 and df.dtypes == spark.range(1).dtypes


def test_view_plans_only_what_it_needs(spark):
    slim = contacts(spark, "/root/testdata/sf0.001", ["marital", "y"])
    plan = slim._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and "lineitem" not in plan
    assert "ReadSchema: struct<o_orderstatus:string,o_orderpriority:string>" in plan


def test_stream_closes_what_the_batch_counts(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    hit = F.col("event_type") == "purchase"
    batch = {r["window_start"]: tuple(r) for r in response_by_window(spark.read.parquet(f"{source}/events.parquet"), "ts", hit).collect()}
    stream = response_by_window(stream_table(spark, source, "events.parquet"), "ts", hit, late="1 hour")
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    write_windows(stream, out, check)
    closed = [tuple(r) for r in spark.read.schema(stream.schema).parquet(out).collect()]
    assert len(batch) - 2 <= len(closed) < len(batch)
    assert all(batch[r[0]] == r for r in closed)
    # A restart finds nothing new and repeats nothing.
    write_windows(response_by_window(stream_table(spark, source, "events.parquet"), "ts", hit, late="1 hour"), out, check)
    assert spark.read.parquet(out).count() == len(closed)


def test_windows_do_not_depend_on_the_session_zone(spark):
    hit = F.col("event_type") == "purchase"
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    utc = sorted(response_by_window(events, "ts", hit).collect())
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        assert sorted(response_by_window(events, "ts", hit).collect()) == utc
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_a_run_written_twice_is_one_run(spark, tmp_path):
    path = str(tmp_path / "runs")
    for metric in (0.5, 0.75):
        for run in ("1", "b"):
            sinks.write_runs(sinks.run_rows(spark, "x", f"name {run}", {"a": 1}, {"f1": metric}, run_id=run), path)
    sinks.write_runs(sinks.run_rows(spark, "y", "other", {}, {"f1": 0.1}, run_id="1"), path)
    found = sinks.run_table(sinks.read_runs(spark, path), ["f1"])
    assert sorted(map(tuple, found.collect())) == [("x", "1", "name 1", 0.75), ("x", "b", "name b", 0.75), ("y", "1", "other", 0.1)]
    assert len(list((tmp_path / "runs").rglob("*.parquet"))) == 3
