"""The contact view over the order tables: one row per order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from campaignlens.functions.scalars import month_label
from campaignlens.operators.history import with_history
from campaignlens.sources.readers import read_table

COLUMNS = [
    "id", "client", "job", "marital", "contact", "nation_key", "balance", "duration",
    "campaign", "day", "month", "previous", "pdays", "poutcome", "y",
]
FROM_CUSTOMER = {"job", "balance", "nation_key", "contact"}
FROM_HISTORY = {"previous", "pdays", "poutcome"}


def contacts(spark: SparkSession, directory: str, columns: Sequence[str] = COLUMNS) -> DataFrame:
    """The wanted columns of the view; joins and windows they do not need are not planned."""
    want = set(columns)
    out = read_table(spark, directory, "orders")
    if want & FROM_HISTORY:
        out = with_history(out, "o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    if want & FROM_CUSTOMER:
        # Same key as the history window, so its partitioning serves this join too.
        customer = read_table(spark, directory, "customer")
        out = out.join(customer, out["o_custkey"] == customer["c_custkey"])
    if "contact" in want:
        nation = read_table(spark, directory, "nation")
        region = read_table(spark, directory, "region")
        out = out.join(nation, out["c_nationkey"] == nation["n_nationkey"]).join(
            region, nation["n_regionkey"] == region["r_regionkey"]
        )
    if "campaign" in want:
        lines = read_table(spark, directory, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"))
        out = out.join(lines, out["o_orderkey"] == lines["l_orderkey"], "left")
    definition = {
        "id": F.col("o_orderkey"),
        "client": F.col("o_custkey"),
        "job": F.col("c_mktsegment") if want & FROM_CUSTOMER else None,
        "marital": F.col("o_orderstatus"),
        "contact": F.col("r_name") if "contact" in want else None,
        "nation_key": F.col("c_nationkey").cast("long") if want & FROM_CUSTOMER else None,
        "balance": F.col("c_acctbal") if want & FROM_CUSTOMER else None,
        "duration": F.col("o_totalprice"),
        "campaign": F.coalesce(F.col("lines"), F.lit(0)).cast("long") if "campaign" in want else None,
        "day": F.dayofmonth("o_orderdate").cast("long"),
        "month": month_label("o_orderdate"),
        "previous": F.col("previous") if want & FROM_HISTORY else None,
        "pdays": F.col("pdays") if want & FROM_HISTORY else None,
        "poutcome": F.col("poutcome") if want & FROM_HISTORY else None,
        "y": F.when(F.col("o_orderpriority") == "1-URGENT", "yes").otherwise("no"),
    }
    return out.select(*[definition[c].alias(c) for c in columns])
