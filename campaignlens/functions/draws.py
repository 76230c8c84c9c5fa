"""Reproducible random order: the md5 of seed and row key.

The order depends on nothing but the seed and the key, so a draw is the same on
any number of executors and after any retry, and another engine can repeat it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(key: str, seed: int) -> Column:
    """Hex digest that orders rows at random; unique when the key is."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def draw_unit(key: str, seed: int) -> Column:
    """The draw as a number in [0, 1), from its first twelve hex digits."""
    return F.conv(F.substring(draw(key, seed), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))
