from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from campaignlens.operators import prep
from campaignlens.plans import modelling


def draws(ids, seed=42):
    return {i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest() for i in ids}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"id": np.arange(1000), "y": rng.choice(["no", "yes", "late"], 1000, p=[0.7, 0.2, 0.1])})
    return spark.createDataFrame(pdf), pdf


def first(pdf, sizes):
    d = draws(pdf["id"])
    keep = set()
    for level, part in pdf.groupby("y"):
        keep |= set(sorted(part["id"], key=d.get)[: sizes[level]])
    return keep


def test_undersample_is_the_first_rows_of_the_draw(rows):
    df, pdf = rows
    n = pdf["y"].value_counts().min()
    assert {r["id"] for r in prep.undersample(df, "y", "id").collect()} == first(pdf, dict.fromkeys(["no", "yes", "late"], n))


def test_many_classes_take_the_join(rows, monkeypatch):
    df, pdf = rows
    few = {r["id"] for r in prep.undersample(df, "y", "id").collect()}
    monkeypatch.setattr(prep, "FEW_CLASSES", 1)
    assert {r["id"] for r in prep.undersample(df, "y", "id").collect()} == few
    counts = prep.stratified_split(df, "y", "id").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in counts} == {"test": 200, "train": 800}


@pytest.mark.parametrize(("test", "total"), [(0.2, 200), (0.3333, 334), (0.0, 0), (1.0, 1000)])
def test_split_size_and_shares(rows, test, total):
    df, pdf = rows
    got = prep.stratified_split(df, "y", "id", test).filter("split = 'test'").toPandas()
    assert len(got) == total
    for level, n in pdf["y"].value_counts().items():
        assert abs((got["y"] == level).sum() - n * total / 1000) < 1


def test_wanting_nothing_or_more_than_there_is(rows):
    df, _ = rows
    assert prep.first_by_draw(df, lambda c: F.lit(0), "id", 1).count() == 0
    assert prep.first_by_draw(df, lambda c: F.lit(5000), "id", 1).count() == 1000
    assert prep.first_by_draw(df.limit(0), lambda c: F.lit(5), "id", 1).count() == 0


def test_codes_follow_sorted_levels(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), (None, 3), ("c", 4)], "s string, id int")
    dictionary = prep.fit_label_dictionary(df, ["s"])
    coded = prep.encode(df, dictionary, ["s"])
    assert {r["id"]: r["s"] for r in coded.collect()} == {1: 1, 2: 0, 3: None, 4: 2}
    assert sorted(prep.decode(coded, dictionary, ["s"]).collect(), key=lambda r: r["id"]) == sorted(
        df.collect(), key=lambda r: r["id"]
    )


def test_codes_of_very_many_levels(spark):
    df = spark.range(5000).select(F.concat(F.lit("v"), F.col("id")).alias("s"), (F.col("id") % 7).alias("t"))
    got = prep._codes_by_sort(prep.fit_label_dictionary(df, ["s", "t"]).select("column", "level")).collect()
    assert got and {(r["column"], r["level"]): r["code"] for r in got} == {
        **{("s", v): i for i, v in enumerate(sorted(f"v{i}" for i in range(5000)))},
        **{("t", str(i)): i for i in range(7)},
    }


def test_unseen_level(spark):
    dictionary = prep.fit_label_dictionary(spark.createDataFrame([("a",)], "s string"), ["s"])
    new = spark.createDataFrame([("z",)], "s string")
    assert prep.encode(new, dictionary, ["s"], strict=False).head()["s"] is None
    with pytest.raises(Exception, match="unseen value in s: z"):
        prep.encode(new, dictionary, ["s"], strict=True).collect()


def test_encode_with_a_large_dictionary(spark, monkeypatch):
    from campaignlens.operators import sizing

    df = spark.createDataFrame([(f"v{i:03d}", i) for i in range(50)], "s string, id int")
    monkeypatch.setattr(prep, "rows_if_small", lambda d, n=0: None)
    got = prep.encode(df, prep.fit_label_dictionary(df, ["s"]), ["s"]).collect()
    assert all(r["s"] == r["id"] for r in got)
    assert sizing.rows_if_small(df, 10) is None


def test_standardize_fits_on_train_only(spark):
    train = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    test = spark.createDataFrame([(5.0, 6.0)], "a double, b double")
    scaled, other = prep.standardize(train, [test], ["a", "b"])
    assert sorted(tuple(r) for r in scaled.collect()) == [(-1.0, 0.0), (1.0, 0.0)]
    assert tuple(other.head()) == (3.0, 1.0)


def test_weights_distribution_and_min_max(spark):
    df = spark.createDataFrame([("no", 1.0)] * 3 + [("yes", 3.0)], "y string, x double")
    weights = {r["y"]: r["weight"] for r in prep.class_weights(df, "y").collect()}
    assert weights == pytest.approx({"no": 4 / 6, "yes": 2.0})
    got = {r["level"]: (r["rows"], r["pct"], r["imbalance"]) for r in prep.class_distribution(df, "y").collect()}
    assert got == {"no": (3, 75.0, 3.0), "yes": (1, 25.0, 3.0)}
    assert {r["x"] for r in prep.min_max(df, ["x"]).collect()} == {0.0, 1.0}
    assert prep.min_max(df.filter("y = 'no'"), ["x"]).head()["x"] is None


def test_assemble_leaves_columns_out(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert prep.assemble(df, ["c", "b", "a"], without=["b"]).head()["features"].toArray().tolist() == [3.0, 1.0]


def test_rows_without_a_label_are_in_neither_part(spark):
    df = spark.createDataFrame([(i, None if i < 20 else "ab"[i % 2]) for i in range(100)], "id long, y string")
    parts = prep.stratified_split(df, "y", "id")
    counts = {r["split"]: r["count"] for r in parts.groupBy("split").count().collect()}
    assert counts == {None: 20, "test": 16, "train": 64}
    assert parts.filter("y IS NULL AND split IS NOT NULL").count() == 0


def test_unseen_levels_are_an_error_unless_asked_for(spark):
    seen, new = (spark.createDataFrame([(x,)], "s string") for x in ("a", "b"))
    dictionary = prep.fit_label_dictionary(seen, ["s"])
    with pytest.raises(Exception, match="unseen value in s"):
        prep.encode(new, dictionary, ["s"]).collect()
    assert prep.encode(new, dictionary, ["s"], strict=False).first()["s"] is None


def test_long_texts_are_not_collected(spark):
    from campaignlens.operators.sizing import rows_if_small

    long = spark.range(300).select(F.repeat(F.lit("x"), 100_000).alias("s"))
    assert rows_if_small(long) is None
    assert rows_if_small(spark.createDataFrame([(["x" * 9_000_000],)], "a array<string>")) is None
    assert len(rows_if_small(long.limit(3))) == 3


def test_smote_reaches_the_largest_class(spark):
    from campaignlens.operators.oversample import smote

    rows = [(i, float(i % 13), float(i % 7), 0 if i < 40 else 2 if i < 90 else 1) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int")
    counts = {r["y"]: r["count"] for r in smote(df, ["a", "b"], "id", "y", minority=1).groupBy("y").count().collect()}
    assert counts == {0: 40, 1: 50, 2: 50}


def test_fits_get_partitions_by_their_rows(spark):
    assert [prep.spread(n) for n in (0, 1, 25_001, 288_000, 2_880_000, 17_300_000, 54_000_000)] == [1, 1, 2, 12, 96, 96, 270]
    rows = prep.placed(spark.range(60_000), "id")
    assert rows.rdd.getNumPartitions() == 3 and rows.count() == 60_000


def test_prepared_rows_lie_in_as_many_files_as_a_fit_has_partitions(spark, monkeypatch):
    monkeypatch.setattr(prep, "spread", lambda rows: 5)
    df = spark.createDataFrame([(i, float(i), "ab"[i % 2], "yes" if i % 3 else "no") for i in range(300)], "id long, x double, c string, y string")
    p = modelling.prepare(df.coalesce(1), "id", ["x"], ["c"])
    assert len(p.train.inputFiles()) == 5 and (p.train.count(), p.test.count()) == (160, 40)
