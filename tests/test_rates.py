from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from campaignlens.operators import rates as R
from campaignlens.operators import rules


@pytest.fixture(scope="module")
def contacts(spark):
    rows = [("a", "yes", 1.0), ("a", "no", 2.0), ("b", "no", 3.0), ("b", "no", 4.0), (None, "yes", 5.0)]
    return spark.createDataFrame(rows, "d string, y string, x double")


def test_value_counts_leave_nulls_out(contacts):
    assert [tuple(r) for r in R.value_counts(contacts, "d").collect()] == [("a", 2, 0.5), ("b", 2, 0.5)]


def test_share_of_an_absent_class_is_zero(contacts):
    got = {r["level"]: (r["no"], r["yes"]) for r in R.response_share(contacts, "d").collect()}
    assert got == {"a": (0.5, 0.5), "b": (1.0, 0.0)}


def test_rate_without_any_positive_row(contacts):
    none = contacts.filter("y = 'no'")
    assert {r["rate"] for r in R.response_rate(none, "d").collect()} == {0.0}
    assert R.overall_rate(none).head()["rate"] == 0.0


def test_empty_bin_is_listed_without_rate(contacts):
    got = R.response_rate_binned(contacts, "x", [0, 2, 4, 9, 20], ["p", "q", "r", "s"]).collect()
    assert [(r["bin"], r["rows"], r["rate"]) for r in got] == [
        ("p", 2, 50.0), ("q", 2, 0.0), ("r", 1, 100.0), ("s", 0, None)]


def test_many_equals_one_by_one(contacts):
    many = {(r["dimension"], r["level"]): (r["rows"], r["rate"]) for r in R.response_rate_many(contacts, ["d", "y"]).collect()}
    for dim in ("d", "y"):
        for r in R.response_rate(contacts, dim).collect():
            assert many.pop((dim, r["level"])) == (r["rows"], r["rate"])
    assert not many


def test_best_and_worst_of_tied_levels(spark):
    rates = spark.createDataFrame([("b", 5.0), ("a", 5.0), ("d", 1.0), ("c", 1.0), ("e", None)], "level string, rate double")
    assert tuple(R.best_worst(rates).head()) == ("a", 5.0, "c", 1.0, 4.0)


def test_reordering_keeps_or_drops_missing_levels(spark):
    rates = spark.createDataFrame([("mar", 2.0), ("jan", 1.0), ("odd", 9.0)], "level string, rate double")
    order = ["jan", "feb", "mar"]
    assert [r["level"] for r in R.reorder_levels(rates, order).collect()] == ["jan", "mar"]
    assert [(r["level"], r["rate"]) for r in R.reorder_levels(rates, order, True).collect()] == [
        ("jan", 1.0), ("feb", None), ("mar", 2.0)]


@pytest.mark.parametrize("limits", [None, (-1.0, 1.0)])
def test_histogram_matches_numpy(spark, limits):
    x = np.random.default_rng(5).normal(size=500).round(2)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    lo, hi = limits or (None, None)
    got = R.histogram(df, "x", 20, lo, hi).orderBy("bin").collect()
    want, edges = np.histogram(x, bins=20, range=limits)
    assert [r["rows"] for r in got] == want.tolist()
    assert [r["from"] for r in got] == pytest.approx(edges[:-1].tolist())


def test_histogram_of_a_constant(spark):
    got = R.histogram(spark.createDataFrame([(2.0,), (2.0,)], "x double"), "x", 4).orderBy("bin").collect()
    assert [r["rows"] for r in got] == np.histogram([2.0, 2.0], bins=4)[0].tolist()


def test_box_stats(spark):
    x = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0]
    df = spark.createDataFrame([("g", v) for v in x], "g string, x double")
    for by in ([], ["g"]):
        r = R.box_stats(df, "x", by).head()
        assert (r["q1"], r["median"], r["q3"]) == (2.25, 3.5, 4.75)
        assert (r["whisker_low"], r["whisker_high"], r["outliers"], r["rows"]) == (1.0, 5.0, 1, 6)
    out = R.outlier_report(df, ["x"]).head()
    assert (out["outliers"], out["rows"]) == (1, 6)


@pytest.mark.parametrize(
    ("counts", "verdict"), [((31, 10), "severe"), ((30, 10), "moderate"), ((15, 10), "balanced"), ((5, 0), "balanced")]
)
def test_imbalance_limits_are_strict(spark, counts, verdict):
    rows = [("no",)] * counts[0] + [("yes",)] * counts[1]
    assert rules.imbalance_verdict(spark.createDataFrame(rows, "y string"), "y").head()["verdict"] == verdict


def test_tiers(spark):
    df = spark.createDataFrame([(0.61,), (0.6,), (0.3,), (0.29,), (None,)], "s double")
    assert [r["tier"] for r in rules.propensity_tier(df, "s").collect()] == ["high", "medium", "medium", "low", None]


def test_projection(spark):
    df = spark.createDataFrame([("yes",)] + [("no",)] * 9, "y string")
    got = {r["plan"]: tuple(r)[1:] for r in rules.campaign_projection(df).collect()}
    assert got["everyone"] == pytest.approx((10, 1, 10)) and got["targeted"] == pytest.approx((5, 1, 20))


def test_missing_group_is_a_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), (None, 9.0), ("a", 5.0)], "g string, v double")
    bins = R.histogram(df, "v", 4, by=["g"]).groupBy("g").agg(F.sum("rows").alias("n")).collect()
    assert {r["g"]: r["n"] for r in bins} == {None: 3, "a": 1}
    assert {r["g"]: r["rows"] for r in R.box_stats(df, "v", ["g"]).collect()} == {None: 3, "a": 1}
