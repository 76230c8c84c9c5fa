"""Every registered query with SQL against DuckDB, and the shape of the plans."""

from __future__ import annotations

import glob
import math
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry_points
from campaignlens.plans.catalog import ORACLES, QUERIES, model_queries
from campaignlens.session import scratch, written

DIRECTORY = "/root/testdata/sf0.001"
# Neighbours and the kernel map run vector code in Python on purpose.
PYTHON = {"nearest_neighbours", "nearest_hashed", "knn_classify", "train_neighbours", "train_rbf_svm", "smote", "silhouettes", "euclidean_silhouette"}


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in glob.glob(f"{DIRECTORY}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def comparable(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(v):
        return None if isinstance(v, float) and math.isnan(v) else v

    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, db, name):
    with scratch(spark):
        df = QUERIES[name](spark, DIRECTORY)
        rows = df.collect()
    found = db.sql(ORACLES[name])
    names = list(found.columns)
    assert sorted(df.columns) == sorted(names)
    assert comparable(df.columns, rows) == comparable(names, found.fetchall())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan)
    if name not in PYTHON:
        assert not re.search("ArrowEvalPython|BatchEvalPython|InPandas", plan)


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert set(QUERIES) <= set(entry_points.queries())


def test_layouts_have_more_files_as_the_rows_grow(spark, monkeypatch):
    files = {}

    def noted(df, name):
        files[name] = df.rdd.getNumPartitions()
        return written(df, name)

    monkeypatch.setattr(model_queries, "written", noted)
    monkeypatch.setattr(model_queries, "FILE_ROWS", 300)
    with scratch(spark):
        rows = model_queries.same_fit_any_layout(spark, DIRECTORY).collect()
    few = -(-len(rows) // 300)
    assert few > 1 and files == {"one-file": few, "thirteen-files": 13 * few}
    assert all(r["same_score"] and r["same_cluster"] for r in rows)


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["dimension", "level", "rows", "rate", "overall", "lift"]
    assert df.count() > 10
