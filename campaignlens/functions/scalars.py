"""Scalar column expressions: encoding, ratios, tests, text, bins."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def map_values(c: str | Column, mapping: Mapping[str, int]) -> Column:
    """Value replaced through ``mapping``; anything else becomes null."""
    c, out = col(c), None
    for old, new in mapping.items():
        out = F.when(c == old, F.lit(new)) if out is None else out.when(c == old, F.lit(new))
    return out


def yes_no(c: str | Column, positive: str = "yes", negative: str = "no") -> Column:
    """1 for the positive label, 0 for the negative one, null for any other."""
    return map_values(c, {positive: 1, negative: 0})


def indicator(predicate: Column) -> Column:
    """1.0 where the predicate holds, else 0.0 (also where it is null)."""
    return F.when(predicate, F.lit(1.0)).otherwise(F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    """Double division that yields null for a zero divisor."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def percent(part: Column, whole: Column) -> Column:
    return ratio(part * F.lit(100.0), whole)


def relative_change(new: Column, old: Column) -> Column:
    """Change from ``old`` to ``new`` in per cent of ``old``."""
    return percent(new - old, old)


def or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def is_missing(c: str | Column, dtype: str) -> Column:
    """Null test that also covers NaN for floating-point columns."""
    c = col(c)
    return c.isNull() | F.isnan(c) if dtype in ("double", "float") else c.isNull()


def number(c: str | Column, dtype: str = "double") -> Column:
    """The column as double with NaN turned into null."""
    c = col(c).cast("double")
    return F.when(~F.isnan(c), c) if dtype in ("double", "float") else c


def slug(c: str | Column) -> Column:
    """Lower case with blanks replaced by underscores."""
    return F.lower(F.regexp_replace(col(c), " ", "_"))


def cut(c: str | Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the right-closed interval ``(edges[i], edges[i+1]]`` that holds the value.

    Values outside all intervals, nulls and NaN get null. Edges may be infinite.
    """
    if len(labels) != len(edges) - 1:
        raise ValueError("need one label fewer than edges")
    c = number(c, "double")
    out = None
    for lo, hi, label in zip(edges, edges[1:], labels):
        inside = F.lit(True)
        if not math.isinf(lo):
            inside = inside & (c > F.lit(float(lo)))
        if not math.isinf(hi):
            inside = inside & (c <= F.lit(float(hi)))
        inside = inside & c.isNotNull()
        out = F.when(inside, F.lit(label)) if out is None else out.when(inside, F.lit(label))
    return out


def signed_log(c: str | Column) -> Column:
    """Logarithm of 1+|x| with the sign of x, for skewed columns that go below zero."""
    c = col(c).cast("double")
    return F.signum(c) * F.log1p(F.abs(c))


# Month labels in calendar order (fixed values).
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def month_label(c: str | Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(col(c)))


def safe_metric(num: Column, den: Column) -> Column:
    """Ratio that is 0 for an empty denominator, as classification metrics define it."""
    return or_zero(ratio(num, den))
