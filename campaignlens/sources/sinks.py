"""Sinks: experiment log, scored lists, delimited contact files, fitted models."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.ml import PipelineModel, Transformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_SCHEMA = "experiment string, run_id string, run_name string, kind string, key string, value string"


def run_rows(
    spark: SparkSession,
    experiment: str,
    run_name: str,
    params: Mapping[str, object],
    metrics: Mapping[str, float],
    run_id: str | None = None,
) -> DataFrame:
    """One run as long rows: a row per parameter and per metric."""
    run_id = run_id or uuid.uuid4().hex
    rows = [(experiment, run_id, run_name, "param", k, str(v)) for k, v in params.items()]
    rows += [(experiment, run_id, run_name, "metric", k, repr(float(v))) for k, v in metrics.items()]
    return spark.createDataFrame(rows, RUN_SCHEMA)


def write_runs(runs: DataFrame, path: str) -> None:
    """Adds runs to the experiment log, one file per run; a run that is written again replaces itself."""
    placed = runs.repartition("experiment", "run_id")
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("experiment", "run_id").parquet(path)


def read_runs(spark: SparkSession, path: str, experiment: str | None = None) -> DataFrame:
    runs = spark.read.schema(RUN_SCHEMA).parquet(path).select(*[f.split()[0] for f in RUN_SCHEMA.split(", ")])
    return runs if experiment is None else runs.filter(F.col("experiment") == experiment)


def run_table(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """The log back in wide form: one row per run, a column per metric."""
    return runs.groupBy("experiment", "run_id", "run_name").agg(
        *[
            F.max(F.when((F.col("kind") == "metric") & (F.col("key") == m), F.col("value")))
            .cast("double")
            .alias(m)
            for m in metrics
        ]
    )


def write_scores(scored: DataFrame, path: str, tier: str = "tier") -> None:
    """Scored prospects, one folder per tier so that a campaign reads only its own."""
    scored.write.mode("overwrite").partitionBy(tier).parquet(path)


def write_contacts(contacts: DataFrame, path: str, sep: str = ";") -> None:
    """Delimited text with a header row, readable by ``read_contacts``."""
    contacts.write.mode("overwrite").option("sep", sep).option("header", True).csv(path)


def save_model(model: Transformer, path: str) -> None:
    """Write a fitted model; anything but a pipeline is wrapped in one."""
    wrapped = model if isinstance(model, PipelineModel) else PipelineModel(stages=[model])
    wrapped.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
