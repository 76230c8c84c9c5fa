"""Delimited contact files and the parquet tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from campaignlens.schema import CONTACT


def read_contacts(
    spark: SparkSession, path: str | Sequence[str], sep: str = ";", schema: T.StructType | None = CONTACT
) -> DataFrame:
    """Delimited text with a header row.

    With a schema the read is lazy; ``schema=None`` infers the types, which costs
    one extra pass over the files.
    """
    reader = spark.read.option("sep", sep).option("header", True)
    reader = reader.option("inferSchema", True) if schema is None else reader.schema(schema)
    return reader.csv(path if isinstance(path, str) else list(path))


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")
