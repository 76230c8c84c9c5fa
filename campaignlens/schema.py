"""The contact table: column names, types and kinds."""

from __future__ import annotations

from pyspark.sql import types as T

# Column order and types of the delimited contact file (fixed values).
CONTACT = T.StructType(
    [
        T.StructField("age", T.IntegerType()),
        T.StructField("job", T.StringType()),
        T.StructField("marital", T.StringType()),
        T.StructField("education", T.StringType()),
        T.StructField("default", T.StringType()),
        T.StructField("balance", T.IntegerType()),
        T.StructField("housing", T.StringType()),
        T.StructField("loan", T.StringType()),
        T.StructField("contact", T.StringType()),
        T.StructField("day", T.IntegerType()),
        T.StructField("month", T.StringType()),
        T.StructField("duration", T.IntegerType()),
        T.StructField("campaign", T.IntegerType()),
        T.StructField("pdays", T.IntegerType()),
        T.StructField("previous", T.IntegerType()),
        T.StructField("poutcome", T.StringType()),
        T.StructField("y", T.StringType()),
    ]
)

# Bins of the published response-rate reports (fixed values).
AGE_EDGES = [0, 30, 40, 50, 60, 100]
AGE_LABELS = ["<30", "30-39", "40-49", "50-59", "60+"]
BALANCE_EDGES = [float("-inf"), 0, 500, 2000, float("inf")]
BALANCE_LABELS = ["Negative", "Low", "Medium", "High"]
CAMPAIGN_EDGES = [0, 1, 2, 3, 5, 100]
CAMPAIGN_LABELS = ["1", "2", "3", "4-5", "6+"]
