from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from campaignlens.operators import models, trees
from campaignlens.operators.prep import assemble


def noisy(spark, n=3000):
    rng = np.random.default_rng(4)
    x, code = rng.normal(size=(n, 3)).round(2), rng.integers(0, 5, n)
    label = (x[:, 0] + (code % 2) + rng.normal(size=n) > 0.5).astype(int)
    rows = [(i, *map(float, r), int(c), int(y)) for i, (r, c, y) in enumerate(zip(x, code, label))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, code long, label int").repartition(3, "id").persist()


NAMES = ["a", "b", "c", "code"]


def test_nodes_grown_by_rows_are_those_split_by_sums(spark):
    """Whether a node is grown whole in a task or split by sums of all tasks, level by level, the forest is the same."""
    df = noisy(spark).select(F.array(*[F.col(c).cast("double") for c in NAMES]).alias("x"), "label")
    for levels in ({}, {3: 5}):
        estimator = RandomForestClassifier(labelCol="label", numTrees=3, maxDepth=6, maxBins=16, seed=3)
        whole, some, none = (trees.fit_forest(df, F.col("x"), estimator, 4, levels, local) for local in (10**9, 300, 0))
        assert whole.toDebugString == some.toDebugString == none.toDebugString
        assert whole.getNumTrees == 3 and whole.numFeatures == 4 and max(t.depth for t in whole.trees) <= 6
        assert ("in {" in whole.toDebugString) == bool(levels)


def test_forest_of_two_classes_is_not_left_to_mllib(spark, monkeypatch):
    """MLlib shuffles a histogram per node and task, which for deep forests is many times the rows; other labels are still its own."""
    df = noisy(spark)
    own = models.train_forest(df, NAMES, trees=20, depth=6, key="id")
    theirs = models._finish("other", RandomForestClassifier(labelCol="label", numTrees=20, maxDepth=6, maxBins=64, seed=42), df, NAMES, {})
    ours, other = (models.evaluate(m, df) for m in (own, theirs))
    assert ours["roc_auc"] == pytest.approx(other["roc_auc"], abs=0.02) and ours["accuracy"] == pytest.approx(other["accuracy"], abs=0.02)
    assert own.model.featureImportances.toArray() == pytest.approx(theirs.model.featureImportances.toArray(), abs=0.06)

    def refused(*_):
        raise AssertionError("fitted by MLlib")

    monkeypatch.setattr(RandomForestClassifier, "fit", refused)
    assert models.train_forest(df, NAMES, trees=2, depth=15).score(df).count() == 3000
    with pytest.raises(AssertionError, match="by MLlib"):
        models.train_forest(df.withColumn("label", F.col("label") + 1), NAMES, trees=2)


def test_forest_refuses_rows_it_cannot_place(spark):
    df = noisy(spark)
    with pytest.raises(Exception, match="null|NaN"):
        models.train_forest(df.withColumn("a", F.when(F.col("id") > 5, F.col("a"))), NAMES, trees=2)
    with pytest.raises(Exception, match="not a code"):
        models.train_forest(df, NAMES, trees=2, nominal={"code": 4})
    endless = df.withColumn("a", F.when(F.col("id") == 5, float("inf")).otherwise(F.col("a")))
    assert models.train_forest(endless, NAMES, trees=2, depth=3).model.getNumTrees == 2


def test_forest_stops_where_nothing_can_be_split(spark):
    same = spark.createDataFrame([(i, 1.0, i % 2) for i in range(20)], "id long, a double, label int")
    assert models.train_forest(same, ["a"], trees=3).model.totalNumNodes == 3
    ones = same.withColumn("label", F.lit(1))
    assert [r["score"] for r in models.train_forest(ones, ["a"], trees=2).score(ones).collect()] == [1.0] * 20
    parted = same.withColumn("a", F.col("label") * 3.0)
    found = models.train_forest(parted, ["a"], trees=3)
    assert found.score(parted).filter("prediction != label").count() == 0 and "(feature 0 <= 1.5)" in found.model.toDebugString


def test_written_nodes_add_up(spark):
    """A parent's classes are its children's, gains are those of its classes, and no split leaves two leaves of one prediction."""
    df = assemble(noisy(spark), NAMES)
    found = models.train_forest(noisy(spark), NAMES, trees=4, depth=8)
    path = f"{spark.conf.get('spark.checkpoint.dir')}/added-up"
    found.model.write().overwrite().save(path)
    nodes = {(r["treeID"], r["nodeData"]["id"]): r["nodeData"] for r in spark.read.parquet(f"{path}/data").collect()}

    def gini(s):
        return 1 - sum((x / sum(s)) ** 2 for x in s)

    assert len({t for t, _ in nodes}) == 4
    for (tree, _), node in nodes.items():
        stats = node["impurityStats"]
        assert node["impurity"] == pytest.approx(gini(stats)) and node["rawCount"] == sum(stats)
        if node["leftChild"] < 0:
            continue
        low, high = nodes[tree, node["leftChild"]], nodes[tree, node["rightChild"]]
        assert stats == [a + b for a, b in zip(low["impurityStats"], high["impurityStats"])]
        shares = [sum(x["impurityStats"]) / sum(stats) * gini(x["impurityStats"]) for x in (low, high)]
        assert node["gain"] == pytest.approx(gini(stats) - sum(shares)) and node["gain"] > 0
        assert low["leftChild"] >= 0 or high["leftChild"] >= 0 or low["prediction"] != high["prediction"]
    # Rows are drawn about once per tree.
    roots = [sum(n["impurityStats"]) for (_, i), n in nodes.items() if i == 0]
    assert len(set(roots)) > 1 and all(abs(n - 3000) < 300 for n in roots) and df.count() == 3000


def test_best_splits_by_brute_force():
    rng = np.random.default_rng(5)
    counts = rng.integers(0, 6, (40, 2, 5, 2)).astype(float)
    counts[rng.random((40, 2, 5)) < 0.3] = 0
    # Both features of a node see the same rows.
    counts[:, 1] = np.take_along_axis(counts[:, 0], rng.permuted(np.tile(np.arange(5), (40, 1)), axis=1)[..., None], axis=1)
    features = np.array([[0, 1], [1, 2]] * 20)

    def gini(a):
        return 1 - ((a / max(a.sum(), 1)) ** 2).sum()

    for levels in ({}, {1: 5}):
        found = trees.best_splits(counts, features, trees.Coding([np.arange(4.0)] * 3, levels))
        for node, of in enumerate(features):
            best = -np.inf
            for j, f in enumerate(of):
                own, n = counts[node, j], counts[node, j].sum()
                sides = [np.arange(5) <= i for i in range(4)] if f not in levels else [np.array([m >> i & 1 for i in range(5)], bool) for m in range(1, 31)]
                for left in sides:
                    a, b = own[left].sum(axis=0), own[~left].sum(axis=0)
                    if a.sum() and b.sum():
                        best = max(best, gini(own.sum(axis=0)) - a.sum() / n * gini(a) - b.sum() / n * gini(b))
            assert found.gain[node] == best == -np.inf or found.gain[node] == pytest.approx(best)


def test_thresholds_lie_between_the_values():
    assert trees.cuts(np.array([3.0, 1.0, 1.0, 2.0]), 64).tolist() == [1.5, 2.5]
    assert trees.cuts(np.array([2.0, 2.0]), 8).tolist() == [] and trees.cuts(np.empty(0), 8).tolist() == []
    many = trees.cuts(np.random.default_rng(1).normal(size=5000), 10)
    assert len(many) == 9 and (np.diff(many) > 0).all() and abs(many[4]) < 0.1
    coding = trees.Coding([np.array([1.5, 2.5]), np.empty(0)], {1: 300})
    assert coding.bins == 300 and coding.codes(np.array([[1.5, 299.0], [1.6, 0.0], [9.0, 4.0]])).tolist() == [[0, 1, 2], [299, 0, 4]]
