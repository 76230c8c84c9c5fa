"""Sample-corrected moments, null-safe correlation and Student's t tail as expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def sample_skewness(c: Column) -> Column:
    """Adjusted Fisher-Pearson skewness; null below three rows or without spread."""
    n = F.count(c).cast("double")
    g = F.skewness(c)
    return F.when(n > 2, g * F.try_divide(F.sqrt(n * (n - 1)), n - 2))


def sample_kurtosis(c: Column) -> Column:
    """Bias-corrected excess kurtosis; null below four rows or without spread."""
    n = F.count(c).cast("double")
    g = F.kurtosis(c)
    scale = F.try_divide(n - 1, (n - 2) * (n - 3))
    return F.when(n > 3, scale * ((n + 1) * g + 6))


def pearson(a: Column, b: Column) -> Column:
    """Pearson correlation over the rows where both are present, null without spread."""
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


STEPS = 400  # terms of the continued fraction; it settles after some tens


def _stirling(z: Column) -> Column:
    return 1 / (12 * z) - 1 / (360 * F.pow(z, F.lit(3.0))) + 1 / (1260 * F.pow(z, F.lit(5.0))) - 1 / (1680 * F.pow(z, F.lit(7.0)))


def _ten(term: Callable[[Column], Column]) -> Column:
    return F.aggregate(F.sequence(F.lit(0), F.lit(9)), F.lit(0.0), lambda total, i: total + term(i))


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for positive numbers: Stirling's series ten places on, and back by the recurrence."""
    z = x + 10
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + _stirling(z) - _ten(lambda i: F.log(x + i))


def log_beta(a: Column, b: Column) -> Column:
    """Logarithm of the beta function; the large terms of a large argument are cancelled before they are rounded."""
    few, many = F.least(a, b), F.greatest(a, b)
    z = many + 10
    rise = (z - 0.5) * F.log1p(few / z) + few * F.log(z + few) - few + _stirling(z + few) - _stirling(z)
    return log_gamma(few) - rise + _ten(lambda i: F.log1p(few / (many + i)))


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, by the modified Lentz method."""

    def kept(v: Column) -> Column:
        return F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)

    def grown(state: Column, term: Column) -> Column:
        d = 1 / kept(1 + term * state["d"])
        c = kept(1 + term / state["c"])
        return F.struct(c.alias("c"), d.alias("d"), (state["value"] * c * d).alias("value"))

    def term(step: Column) -> Column:
        m = F.floor(step / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.when(step % 2 == 0, even).otherwise(odd)

    first = 1 / kept(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("value"))
    return F.aggregate(F.sequence(F.lit(2), F.lit(STEPS)), start, lambda state, step: grown(state, term(step)), lambda state: state["value"])


def incomplete_beta(a: Column, b: Column, x: Column, rest: Column | None = None) -> Column:
    """The regularised incomplete beta function I_x(a, b), for positive a and b and x from 0 to 1; null if one is null.

    ``rest`` is 1 - x, where that is known more exactly than from x.
    """
    y = 1 - x if rest is None else rest
    log_x = F.when(x > 0.5, F.log1p(-y)).otherwise(F.log(x))
    log_y = F.when(y > 0.5, F.log1p(-x)).otherwise(F.log(y))
    front = F.exp(a * log_x + b * log_y - log_beta(a, b))
    inside = F.when(x < (a + 1) / (a + b + 2), front * _beta_fraction(a, b, x) / a).otherwise(1 - front * _beta_fraction(b, a, y) / b)
    return F.when(x <= 0, F.lit(0.0)).when(y <= 0, F.lit(1.0)).when(x.isNotNull() & a.isNotNull() & b.isNotNull(), inside)


def t_two_sided(t: Column, df: Column) -> Column:
    """Probability of a Student t at least as far from zero on either side."""
    both = df + t * t
    return incomplete_beta(df / 2, F.lit(0.5), df / both, t * t / both)
