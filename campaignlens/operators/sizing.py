"""Size checks that come before any broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from campaignlens.session import written

SMALL_ROWS = 10_000
SMALL_BYTES = 8 << 20


def rows_if_small(df: DataFrame, max_rows: int = SMALL_ROWS) -> list[Row] | None:
    """The rows when there are at most ``max_rows`` and they hold at most SMALL_BYTES, otherwise None.

    Rows and bytes are counted in Spark, on at most ``max_rows + 1`` rows, before
    any row comes to the driver; the rows are written once in between.
    """
    few = written(df.limit(max_rows + 1), "small")
    size = F.octet_length(F.to_json(F.struct(*few.columns))) if few.columns else F.lit(0)
    rows, held = few.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return few.collect() if rows <= max_rows and held <= SMALL_BYTES else None


def small_side(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` ready for a broadcast join if it proves small, else ``df`` unchanged.

    The small form holds the rows already computed, so the aggregate behind it
    does not run again. In the large form the join shuffles and adaptive
    execution splits skewed keys.
    """
    rows = rows_if_small(df, max_rows)
    if rows is None:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
