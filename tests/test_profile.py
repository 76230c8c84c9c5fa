from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from campaignlens.operators import profile as P
from campaignlens.operators import quantiles as Q

NAN = float("nan")


@pytest.fixture(scope="module")
def holes(spark):
    rows = [(1, 1.0, "a"), (2, NAN, None), (3, None, "a"), (4, 1.0, "a"), (5, NAN, "b")]
    return spark.createDataFrame(rows, "id int, x double, s string")


def test_missing_report_counts_null_and_nan(holes):
    got = [tuple(r) for r in P.missing_report(holes).collect()]
    assert got == [("x", 3, 60.0), ("s", 1, 20.0)]
    total = P.completeness(holes).head()
    assert total["missing_total"] == 4 and total["completeness_pct"] == pytest.approx(100 - 400 / 15)


def test_missing_report_of_a_whole_table_is_empty(spark):
    assert P.missing_report(spark.range(3)).count() == 0


def test_column_profile_and_schema(holes):
    assert {(r["column"], r["non_null"]) for r in P.column_profile(holes).collect()} == {("id", 5), ("x", 2), ("s", 4)}
    assert [tuple(r) for r in P.schema_table(holes).collect()] == [(1, "id", "int"), (2, "x", "double"), (3, "s", "string")]
    assert P.columns_of_kind(holes, "numeric") == ["id", "x"] and P.columns_of_kind(holes, "text") == ["s"]


def test_duplicates_match_pandas(spark):
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, "a"), (None, None), (None, None), (None, None), (2, None), (None, "2")]
    df = spark.createDataFrame(rows, "x int, s string")
    assert P.duplicate_count(df).head()[0] == int(pd.DataFrame(rows).duplicated().sum()) == 4
    assert P.duplicate_count(df.limit(0)).head()[0] == 0


def test_duplicates_when_one_row_is_a_third(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("x"))
    assert P.duplicate_count(df).head()[0] == 999


def test_mode_takes_the_smallest_of_tied_values(spark):
    df = spark.createDataFrame([(2, "b"), (2, "b"), (1, "a"), (1, "a"), (3, None)], "x int, s string")
    got = {r["column"]: (r["num"], r["txt"], r["rows"]) for r in P.value_modes(df, ["x", "s"]).collect()}
    assert got == {"x": (1.0, None, 2), "s": (None, "a", 2)}
    assert tuple(P.mode_level(df, "s").head()) == ("a", 2)


def test_describe_matches_pandas(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b"], 200), "x": rng.normal(size=200), "n": rng.integers(0, 9, 200)})
    pdf.loc[::7, "x"] = np.nan
    got = P.describe(spark.createDataFrame(pdf), ["x", "n"], ["g"]).toPandas().set_index(["g", "column"])
    for g, part in pdf.groupby("g"):
        want = part[["x", "n"]].describe().T
        for c in ("x", "n"):
            row = got.loc[(g, c)]
            names = ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]
            assert row[names].astype(float).tolist() == pytest.approx(want.loc[c].tolist())


def test_std_of_one_row_is_null(spark):
    row = P.describe(spark.createDataFrame([(1.0,)], "x double"), ["x"]).head()
    assert row["std"] is None and row["q50"] == 1.0


def test_correlation_matches_pandas_pairwise(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(rng.normal(size=(80, 3)), columns=["a", "b", "c"])
    pdf["d"] = 5.0
    pdf.loc[::5, "a"] = np.nan
    pdf.loc[::9, "b"] = np.nan
    cols = ["a", "b", "c", "d"]
    got = {(r["f1"], r["f2"]): r["r"] for r in P.correlation_matrix(spark.createDataFrame(pdf), cols).collect()}
    want = pdf[cols].corr()
    assert len(got) == 16
    for (x, y), r in got.items():
        if math.isnan(want.loc[x, y]):
            assert r is None
        else:
            assert r == pytest.approx(want.loc[x, y])


def test_target_correlation_has_null_last(spark):
    pdf = pd.DataFrame({"t": [1.0, 2, 3, 4], "up": [1.0, 2, 3, 5], "down": [4.0, 3, 2, 1], "flat": [1.0, 1, 1, 1]})
    got = P.target_correlation(spark.createDataFrame(pdf), list(pdf.columns), "t", 1).collect()
    assert [(r["side"], r["feature"]) for r in got] == [("highest", "up"), ("lowest", "down")]


def test_welch(spark):
    a, b = [1.0, 2.0, 3.0, 4.0, 9.0], [2.0, 2.0, 4.0]
    rows = [("a", v) for v in a] + [("b", v) for v in b]
    got = P.welch_t(spark.createDataFrame(rows, "g string, x double"), "x", "g", "a", "b").head()
    va, vb = np.var(a, ddof=1) / 5, np.var(b, ddof=1) / 3
    assert got["t"] == pytest.approx((np.mean(a) - np.mean(b)) / math.sqrt(va + vb))
    assert got["df"] == pytest.approx((va + vb) ** 2 / (va**2 / 4 + vb**2 / 2))


def test_sample_exact_ways_agree(spark):
    df = spark.range(30_000)
    small = {r[0] for r in P.sample_exact(df, 10_000, "id").collect()}
    large = {r[0] for r in P.sample_exact(df, 10_001, "id").collect()}
    assert len(small) == 10_000 and len(large) == 10_001 and small < large


DISTRIBUTIONS = {
    "normal": lambda r, n: r.normal(size=n),
    "few levels": lambda r, n: r.integers(0, 4, n).astype(float),
    "one value holds a third": lambda r, n: np.where(np.arange(n) % 3 == 0, 7.5, r.normal(size=n) * 100),
    "constant": lambda r, n: np.full(n, 3.0),
    "skewed with gaps": lambda r, n: np.floor(r.pareto(1.0, n) * 10),
}


@pytest.mark.parametrize("name", DISTRIBUTIONS)
@pytest.mark.parametrize("limits", [{}, {"cell_rows": 300}, {"cell_rows": 20, "accuracy": 50}])
def test_quantiles_are_exact(spark, name, limits):
    rng = np.random.default_rng(3)
    n = 5003
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", None], n, p=[0.8, 0.1, 0.1]), "x": DISTRIBUTIONS[name](rng, n)})
    pdf.loc[::11, "x"] = np.nan
    probs = [0.0, 0.25, 0.5, 0.75, 0.99, 1.0]
    df = spark.createDataFrame(pdf)
    whole = {r["prob"]: r["value"] for r in Q.quantiles(df, ["x"], probs, **limits).collect()}
    assert [whole[p] for p in probs] == pytest.approx(pdf["x"].quantile(probs).tolist())
    grouped = {(r["g"], r["prob"]): r["value"] for r in Q.quantiles(df, ["x"], probs, ["g"], **limits).collect()}
    for g, part in pdf.groupby(pdf["g"].fillna("none")):
        key = None if g == "none" else g
        assert [grouped[(key, p)] for p in probs] == pytest.approx(part["x"].quantile(probs).tolist())


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "x double")
    for limits in ({}, {"cell_rows": 0}):
        assert Q.quantiles(df, ["x"], [0.5], **limits).count() == 0


@pytest.fixture(scope="module")
def wide():
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(rng.normal(size=(300, 70)), columns=[f"c{i}" for i in range(70)])
    pdf["c1"] += 1e7
    pdf["c2"] = 1e9 + pdf["c1"]
    pdf["c4"] = 3.25
    pdf["c69"] = pdf["c0"] * 2 + 1
    pdf.iloc[:, 5] = np.where(np.arange(300) < 250, np.nan, pdf.iloc[:, 5])
    pdf["c6"] = np.nan
    for k in range(7, 40):
        pdf.loc[::k, f"c{k}"] = np.nan
    return pdf


@pytest.mark.parametrize("parts", [1, 9])
def test_correlations_of_many_columns_come_from_one_scan(spark, wide, monkeypatch, parts):
    from campaignlens.operators import gram

    monkeypatch.setattr(gram, "CELLS", 900)
    df = spark.createDataFrame(wide.astype(object).where(wide.notna(), None), ", ".join(f"{c} double" for c in wide.columns)).repartition(parts)
    found = P.correlation_matrix(df, list(wide.columns))
    want = wide.corr()
    rows = found.collect()
    assert len(rows) == 70 * 70
    for r in rows:
        expected = want.loc[r["f1"], r["f2"]]
        if r["f1"] in ("c4", "c6") or r["f2"] in ("c4", "c6"):
            assert r["r"] is None
        else:
            assert abs(r["r"] - expected) < 1e-6, (r, expected)
    strong = P.high_correlation_pairs(df, list(wide.columns), 0.9).collect()
    assert sorted((r["f1"], r["f2"]) for r in strong) == [("c0", "c69"), ("c1", "c2")]
    ends = P.target_correlation(df, list(wide.columns), "c0", 1).where("side = 'highest'").head()
    assert ends["feature"] == "c69"


def test_wide_correlations_read_the_rows_once(spark, tmp_path, wide):
    spark.createDataFrame(wide).write.parquet(str(tmp_path / "wide"))
    df = spark.read.parquet(str(tmp_path / "wide"))
    plan = P.correlation_matrix(df, list(wide.columns))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Generate" not in plan


def test_correlations_of_nothing(spark):
    df = spark.createDataFrame([], ", ".join(f"c{i} double" for i in range(12)))
    found = P.correlation_matrix(df, df.columns)
    assert found.count() == 144 and found.where("r IS NOT NULL").count() == 0
    assert P.high_correlation_pairs(df, ["c0"]).count() == 0


def test_cells_of_a_large_group_stay_small(spark):
    n, bound = 1_000_000, 500
    df = spark.range(n).select((F.xxhash64("id") / F.lit(2.0**40)).alias("x"), F.when(F.col("id") < 100, "few").alias("g"))
    probs = [0.25, 0.5, 0.75]
    cells = Q.selected(df, ["x"], probs, ["g"], bound, 10_000, 30.0)
    sizes = [(r["g"], r["count"]) for r in cells.groupBy("g", "i", "base").count().collect()]
    assert max(k for _, k in sizes) <= bound and len(sizes) <= 2 * 2 * len(probs)
    values = df.where("g IS NULL").toPandas()["x"]
    got = {r["prob"]: r["value"] for r in Q.quantiles(df, ["x"], probs, ["g"], bound, margin=30.0).where("g IS NULL").collect()}
    assert [got[p] for p in probs] == pytest.approx(values.quantile(probs).tolist(), rel=1e-12)


def test_missed_brackets_are_widened(spark):
    from campaignlens.operators.quantiles import quantiles

    rng = np.random.default_rng(11)
    values = rng.normal(size=3000).round(3)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    probs = [0.01, 0.25, 0.5, 0.77, 0.99]
    found = quantiles(df, ["v"], probs, cell_rows=0, accuracy=10, margin=0.0)
    got = {r["prob"]: r["value"] for r in found.collect()}
    assert all(abs(got[p] - np.quantile(values, p)) < 1e-9 for p in probs)
