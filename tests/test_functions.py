from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from campaignlens.functions import scalars as S
from campaignlens.functions.moments import sample_kurtosis, sample_skewness, t_two_sided

FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
NUMBERS = st.lists(st.integers(-50, 150), min_size=1, max_size=60)


@FEW
@given(NUMBERS)
def test_cut_is_right_closed(spark, values):
    edges, labels = [-math.inf, 0, 30, 40, 100], ["a", "b", "c", "d"]
    got = spark.createDataFrame([(v,) for v in values], "x int").select("x", S.cut("x", edges, labels)).collect()
    want = pd.cut(pd.Series([r[0] for r in got]), bins=edges, labels=labels)
    assert [r[1] for r in got] == [None if pd.isna(w) else w for w in want]


def test_cut_of_nan_and_null(spark):
    rows = spark.createDataFrame([(float("nan"),), (None,)], "x double")
    got = rows.select(S.cut("x", [-math.inf, 0, math.inf], ["low", "high"])).collect()
    assert [r[0] for r in got] == [None, None]


def test_cut_needs_matching_labels():
    with pytest.raises(ValueError):
        S.cut("x", [0, 1], ["a", "b"])


@FEW
@given(st.lists(st.integers(-20, 20), min_size=4, max_size=50))
def test_moments_match_pandas(spark, values):
    s = pd.Series(values, dtype=float)
    row = (
        spark.createDataFrame([(float(v),) for v in values], "x double")
        .agg(sample_skewness(F.col("x")), sample_kurtosis(F.col("x")))
        .head()
    )
    if s.nunique() == 1:
        assert row[0] is None and row[1] is None
    else:
        assert row[0] == pytest.approx(s.skew(), abs=1e-6)
        assert row[1] == pytest.approx(s.kurtosis(), abs=1e-6)


def test_few_rows_have_no_moments(spark):
    row = spark.createDataFrame([(1.0,), (2.0,)], "x double").agg(
        sample_skewness(F.col("x")), sample_kurtosis(F.col("x"))
    )
    assert tuple(row.head()) == (None, None)


def test_scalars(spark):
    df = spark.createDataFrame([("yes", 3.0, 0.0, "Random Forest"), ("maybe", 3.0, 2.0, "A B")], "y string, a double, b double, m string")
    got = df.select(
        S.yes_no("y"), S.ratio(F.col("a"), F.col("b")), S.safe_metric(F.col("a"), F.col("b")), S.slug("m"),
        S.relative_change(F.col("a"), F.col("b")),
    ).collect()
    assert tuple(got[0]) == (1, None, 0.0, "random_forest", None)
    assert tuple(got[1]) == (None, 1.5, 1.5, "a_b", 50.0)


def test_signed_log_keeps_the_sign(spark):
    xs = [-99.0, 0.0, 99.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(S.signed_log("x")).collect()]
    assert got == pytest.approx([-math.log(100), 0.0, math.log(100)])


def test_months_follow_the_calendar(spark):
    df = spark.sql("select timestamp_ntz'2024-02-29 23:59:59' as t union all select timestamp_ntz'2023-12-01 00:00:00'")
    assert {r[0] for r in df.select(S.month_label("t")).collect()} == {"feb", "dec"}
    assert len(S.MONTHS) == len(np.unique(S.MONTHS)) == 12


def test_student_t_tail(spark):
    """Against a numeric integral of the density over the angle, from one degree of freedom to very many."""
    cases = [(t, df) for df in (1.0, 2.5, 30.0, 5000.0, 1e6, 1e9) for t in (0.0, 0.3, 1.0, 1.72, 1.75, -3.0, 6.0)]
    rows = spark.createDataFrame(cases, "t double, df double").withColumn("p", t_two_sided(F.col("t"), F.col("df"))).collect()
    for r in rows:
        if r["df"] > 1e5:
            want = math.erfc(abs(r["t"]) / math.sqrt(2))
            assert r["p"] == pytest.approx(want, abs=2 / r["df"] + 1e-9)
            continue
        low = math.atan(abs(r["t"]) / math.sqrt(r["df"]))
        areas = []
        for a in (low, 0.0):
            x = np.linspace(a, math.pi / 2, 400_001)
            y = np.cos(x).clip(0) ** (r["df"] - 1)
            areas.append((y[0] + y[-1] + 4 * y[1::2].sum() + 2 * y[2:-1:2].sum()) * (x[1] - x[0]) / 3)
        assert r["p"] == pytest.approx(areas[0] / areas[1], rel=1e-8, abs=1e-12)
    assert spark.range(1).select(t_two_sided(F.lit(None).cast("double"), F.lit(3.0))).head()[0] is None
