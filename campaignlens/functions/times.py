"""Time helpers that give the same answer in every session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def micros(c: str, dtype: str) -> Column:
    """Microseconds since 1970 as a long; clock time is read as UTC."""
    if dtype == "timestamp":
        return F.unix_micros(F.col(c))
    return F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, CAST(`{c}` AS TIMESTAMP_NTZ))")


def instant(c: str, dtype: str) -> Column:
    """The column as a point in time (watermarks take no clock time)."""
    return F.col(c) if dtype == "timestamp" else F.timestamp_micros(micros(c, dtype))


def utc_clock(c: str) -> Column:
    """A point in time as UTC clock time."""
    return F.expr(f"timestampadd(MICROSECOND, unix_micros({c}), {_EPOCH})")
