from __future__ import annotations

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from campaignlens.functions.draws import draw_unit
from campaignlens.operators import boxes, hashed, margins, means, models, neighbors, oversample, passes, pivots, segments, silhouette
from campaignlens.operators.prep import assemble, placed
from campaignlens.sources import sinks


def toy(spark, n=240, ring=False, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    label = (x**2).sum(1) > 1.4 if ring else x[:, 0] + 0.5 * x[:, 1] > 0
    pdf = pd.DataFrame({"id": np.arange(n), "a": x[:, 0], "b": x[:, 1], "label": label.astype(int)})
    return spark.createDataFrame(pdf).persist()


@pytest.mark.parametrize(
    "train",
    [
        lambda d: models.train_logistic(d, ["a", "b"]),
        lambda d: models.train_forest(d, ["a", "b"], trees=10, depth=5),
        lambda d: models.train_boosting(d, ["a", "b"], rounds=5, depth=3),
        lambda d: models.train_neighbors(d, ["a", "b"], "id"),
    ],
    ids=["logistic", "forest", "boosting", "neighbours"],
)
def test_separable_rows_are_learned(spark, train):
    df = toy(spark)
    fitted = train(df)
    got = models.evaluate(fitted, toy(spark, seed=1))
    assert got["roc_auc"] > 0.9
    scores = [r["score"] for r in fitted.score(df).collect()]
    assert len(scores) == 240 and all(0 <= s <= 1 for s in scores)


def test_kernel_model_learns_a_ring(spark):
    df, other = toy(spark, ring=True), toy(spark, ring=True, seed=1)
    svm = models.train_rbf_svm(df, ["a", "b"], "id", dims=64, max_iter=30)
    assert models.evaluate(svm, other)["roc_auc"] > 0.9
    assert models.evaluate(models.train_logistic(df, ["a", "b"]), other)["roc_auc"] < 0.75


def test_kernel_fits_share_their_passes_over_the_raw_rows(spark, monkeypatch):
    """Nothing lifted is kept, a pass serves the fits of all folds and of all rows, and each is as good as MLlib's."""
    df, kept, fits = toy(spark, ring=True), [], []
    total, fit_many = passes.Blocks.total, margins.fit_many
    monkeypatch.setattr(passes.Blocks, "total", lambda self, *a: kept.append(self.width) or total(self, *a))
    monkeypatch.setattr(margins, "fit_many", lambda *a: fits.extend([a, fit_many(*a)]) or fits[1])
    models.train_rbf_svm(df.withColumn("id", F.when(F.col("id") >= 10, F.col("id"))), ["a", "b"], "id", dims=32)
    (_, waves, left_out, penalty, *_), found = fits
    assert set(kept) == {4} and left_out == [0, 1, 2, None]
    assert len(kept) == 1 + max(m.passes for m in found) < sum(m.passes for m in found)
    rows = df.withColumn("fold", F.floor(draw_unit("id", 43) * 3)).toPandas()
    z = np.vstack([part.copy() for _, part in waves.lifted(rows[["a", "b"]].to_numpy())])
    by_cosine = np.sqrt(2 / 32) * np.cos(2 * np.pi * (rows[["a", "b"]].to_numpy() @ waves.weights + waves.shift))
    assert np.abs(z - by_cosine).max() < 1e-14
    side = 2 * rows["label"].to_numpy() - 1
    # The ten rows without a key are in no fold.
    for machine, out in zip(found, left_out):
        seen = np.ones(240, bool) if out is None else ((rows["fold"] != out) & (rows["id"] >= 10)).to_numpy()

        def objective(weights, intercept):
            return np.maximum(1 - side * (z @ weights + intercept), 0)[seen].mean() + penalty / 2 * (weights @ weights)

        lifted = spark.createDataFrame(pd.DataFrame({"label": rows["label"][seen], "z": list(map(list, z[seen]))}))
        svc = LinearSVC(maxIter=100, tol=1e-3, regParam=penalty, standardization=False, featuresCol="v")
        other = svc.fit(lifted.select("label", array_to_vector("z").alias("v")))
        assert machine.value == pytest.approx(objective(machine.weights, machine.intercept))
        assert machine.value < objective(other.coefficients.toArray(), other.intercept) + 2e-3


@pytest.mark.parametrize("label", [None, 2, 0])
def test_kernel_fits_refuse_other_labels(spark, label):
    df = spark.createDataFrame([(i, float(i), float(-i), label if label is None or i else 0) for i in range(9)], "id long, a double, b double, label int")
    with pytest.raises(Exception, match="null|neither 0 nor 1|no row of label 1"):
        models.train_rbf_svm(df, ["a", "b"], "id", dims=8)


def test_same_seed_same_predictions_and_importances(spark):
    df = toy(spark)
    one, two = (models.train_forest(df, ["a", "b"], trees=5, depth=4) for _ in range(2))
    assert [r["score"] for r in one.score(df).orderBy("id").collect()] == [
        r["score"] for r in two.score(df).orderBy("id").collect()
    ]
    table = models.feature_importance(one, df).collect()
    assert sum(r["importance"] for r in table) == pytest.approx(1.0) and table[0]["feature"] == "a"
    coef = models.coefficients(models.train_logistic(df, ["a", "b"]), df).collect()
    assert [r["feature"] for r in coef] == ["a", "b"]
    assert models.importance_or_coefficients(models.train_neighbors(df, ["a", "b"], "id"), df).count() == 0


def test_permutation_finds_the_feature_that_matters(spark):
    df = toy(spark).withColumn("noise", F.rand(1))
    fitted = models.train_logistic(df, ["a", "noise"])
    loss = {r["feature"]: r["loss"] for r in models.permutation_importance(fitted, df, "id").collect()}
    assert loss["a"] > 0.2 > abs(loss["noise"])


def test_models_and_runs_are_read_back(spark, tmp_path):
    df = toy(spark)
    fitted = models.train_logistic(df, ["a", "b"])
    sinks.save_model(fitted.model, str(tmp_path / "m"))
    again = sinks.load_model(str(tmp_path / "m")).transform(assemble(df, ["a", "b"]))
    assert again.count() == 240 and "probability" in again.columns
    path = str(tmp_path / "runs")
    for i in range(2):
        runs = sinks.run_rows(spark, "e", f"r{i}", {"k": 5}, {"f1": 0.5 + i / 10})
        sinks.write_runs(runs, path)
    table = sinks.run_table(sinks.read_runs(spark, path, "e"), ["f1"]).orderBy("run_name").collect()
    assert [(r["run_name"], r["f1"]) for r in table] == [("r0", 0.5), ("r1", 0.6)]


def brute(train, queries, k):
    out = {}
    for q, x in queries:
        d = [(float(np.sqrt(((np.array(v) - np.array(x)) ** 2).sum())), t) for t, v in train]
        out[q] = [(t, dist) for dist, t in sorted(d)[:k]]
    return out


@pytest.mark.parametrize(("pivots", "block"), [(None, 4096), (6, 16), (1, 7)])
def test_nearest_matches_brute_force(spark, pivots, block):
    rng = np.random.default_rng(9)
    hot = [1.0, 1.0, 1.0]
    # A third of the training rows are copies of one point.
    train = [(i, hot if i % 3 == 0 else rng.normal(size=3).round(1).tolist()) for i in range(180)]
    queries = [(1000 + i, hot if i % 5 == 0 else rng.normal(size=3).round(1).tolist()) for i in range(40)]
    schema = "id long, v array<double>"
    got = neighbors.nearest(
        spark.createDataFrame(train, schema), spark.createDataFrame(queries, schema), 5, "id", "v", pivots=pivots, block=block
    ).collect()
    want = brute(train, queries, 5)
    found = {}
    for r in sorted(got, key=lambda r: (r["query"], r["rank"])):
        found.setdefault(r["query"], []).append((r["neighbour"], r["distance"]))
    assert found.keys() == want.keys()
    for q in want:
        assert [t for t, _ in found[q]] == [t for t, _ in want[q]]
        assert [d for _, d in found[q]] == pytest.approx([d for _, d in want[q]])


def test_fewer_training_rows_than_neighbours(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [1.0])], "id long, v array<double>")
    assert neighbors.nearest(df, df, 5, "id", "v").count() == 4
    assert neighbors.nearest(df.limit(0), df, 5, "id", "v").count() == 0


def test_vectors_without_a_place_hide_no_others(spark):
    train = spark.createDataFrame([(1, [0.0]), (2, [float("nan")]), (3, [1.0]), (4, [None]), (5, None)], "id long, v array<double>")
    asked = spark.createDataFrame([(7, [0.1]), (8, [float("nan")])], "id long, v array<double>")
    got = neighbors.nearest(train, asked, 2, "id", "v").orderBy("rank").collect()
    assert [(r["query"], r["neighbour"]) for r in got] == [(7, 1), (7, 3)]


def test_boxes_open_few_cells_and_find_all():
    rng = np.random.default_rng(12)
    train, queries, k = rng.uniform(size=(20_000, 3)).round(3), rng.uniform(size=(300, 3)).round(3), 5
    keys = rng.permutation(len(train))
    away = np.sqrt(((queries[:, None] - train[None]) ** 2).sum(axis=2))
    want = np.array([np.lexsort((keys, d))[:k] for d in away])
    who, where, dist = boxes.nearest_rows(queries, np.full(len(queries), np.inf), train, keys, k)
    assert (where.reshape(-1, k) == want).all() and (who == np.repeat(np.arange(300), k)).all()
    kth = dist.reshape(-1, k)[:, -1]
    again = boxes.nearest_rows(queries, kth, train, keys, k)
    assert (again[1] == where).all()
    assert len(boxes.nearest_rows(queries, kth / 1e6, train, keys, k)[0]) == (away <= (kth / 1e6)[:, None]).sum()

    cuts = boxes.Cuts(train[::20], 64)
    cell = cuts.cell(train)
    sizes = np.bincount(cell, minlength=64)
    assert cuts.cells == 64 and sizes.min() > 150 and sizes.max() < 800
    low, high = (np.array([f(train[cell == c], axis=0) for c in range(64)]) for f in (np.min, np.max))
    rows, at = (np.concatenate(x) for x in zip(*boxes.opened(queries, kth, low, high)))
    # Every cell of a neighbour is opened, and few others.
    assert {(int(a), int(cell[b])) for a, b in zip(who, where)} <= set(zip(rows.tolist(), at.tolist()))
    assert len(rows) < 300 * 10
    assert boxes.Cuts(np.ones((50, 2)), 8).cells == 1


def test_votes(spark):
    train = spark.createDataFrame([(1, [0.0], 1), (2, [0.1], 0), (3, [0.2], 1), (4, [9.0], 0)], "id long, v array<double>, label int")
    got = neighbors.knn_classify(train, train.filter("id = 1"), "id", "v", "label", 2).head()
    assert (got["prediction"], got["votes"], got["score"]) == (0.0, 1, 0.5)
    got = neighbors.knn_classify(train, train.filter("id = 1"), "id", "v", "label", 3).head()
    assert (got["prediction"], got["votes"]) == (1.0, 2) and got["score"] == pytest.approx(2 / 3)


def test_smote_evens_the_classes_between_neighbours(spark):
    rng = np.random.default_rng(3)
    rows = [(i, *rng.normal(size=2).tolist(), int(i < 20)) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, a double, b double, label int")
    out = oversample.smote(df, ["a", "b"], "id", "label").toPandas()
    assert (out["label"] == 1).sum() == (out["label"] == 0).sum() == 70
    minor = out[(out["label"] == 1) & ~out["synthetic"]]
    made = out[out["synthetic"]]
    assert made[["a", "b"]].min().ge(minor[["a", "b"]].min()).all() and made[["a", "b"]].max().le(minor[["a", "b"]].max()).all()
    points = minor[["a", "b"]].to_numpy()
    near = {
        i: np.argsort(((points - points[i]) ** 2).sum(1), kind="stable")[1:6] for i in range(len(points))
    }
    for p in made[["a", "b"]].to_numpy():
        on_line = False
        for i, js in near.items():
            for j in js:
                step = points[j] - points[i]
                t = np.dot(p - points[i], step) / np.dot(step, step)
                on_line |= -1e-9 <= t <= 1 + 1e-9 and np.allclose(points[i] + t * step, p)
        assert on_line
    assert oversample.smote(df.filter("label = 0"), ["a", "b"], "id", "label").count() == 70


def test_smote_names_the_parents(spark):
    rows = [(i, float(i % 7), float(i * i % 11), int(i < 9)) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, a double, b double, label int")
    out = oversample.smote(df, ["a", "b"], "id", "label", parents=True).toPandas()
    assert out[~out["synthetic"]][["parent", "neighbour"]].isna().all().all() and out["synthetic"].sum() == 12
    at = {i: np.array([a, b]) for i, a, b, _ in rows}
    for r in out[out["synthetic"]].itertuples():
        p, o, m = at[int(r.parent)], at[int(r.neighbour)], np.array([r.a, r.b])
        assert r.parent < 9 and r.neighbour < 9 and r.parent != r.neighbour
        assert abs(np.linalg.norm(m - p) + np.linalg.norm(m - o) - np.linalg.norm(p - o)) < 1e-9
    balanced = oversample.smote(df.filter("label = 0"), ["a", "b"], "id", "label", parents=True)
    assert balanced.columns == ["id", "a", "b", "label", "synthetic", "parent", "neighbour"]


def test_all_starts_share_their_passes(spark):
    """A sweep makes as many passes over the rows as its longest start needs, and its centres are fixed points."""
    rng = np.random.default_rng(8)
    rows = [(rng.normal(size=2) + 6 * np.array([i % 2, i % 3 == 0])).tolist() for i in range(3000)]
    df = spark.createDataFrame([(r,) for r in rows], "x array<double>").repartition(3).persist()
    made = passes.Blocks(df, "x")
    seen, total = [], made.total
    made.total = lambda *a: seen.append(1) or total(*a)
    found = means.fit_many(made, [(k, s) for k in (1, 2, 4) for s in range(5)], 100)
    assert len(seen) == max(m.iterations for m in found) + means.ROUNDS + 3 < sum(m.iterations for m in found)
    points = np.array(rows)
    for m in found:
        away = ((points[:, None] - m.centres[None]) ** 2).sum(axis=2)
        assert m.cost == pytest.approx(away.min(axis=1).sum())
        again = np.array([points[away.argmin(axis=1) == c].mean(axis=0) for c in range(len(m.centres))])
        assert np.abs(again - m.centres).max() < 0.02
    assert min(m.cost for m in found[10:]) < 6500 and found[0].centres[0] == pytest.approx(points.mean(axis=0))
    made.drop()
    # Fewer distinct rows than clusters; rows that are no vectors.
    few = passes.Blocks(spark.createDataFrame([([1.0],), ([1.0],), ([2.0],)], "x array<double>"), "x")
    assert means.fit_many(few, [(3, 1)], 10)[0].cost == 0
    few.drop()


def test_kmeans_model_has_its_summary(spark):
    df = assemble(spark.createDataFrame([(float(i % 2), float(i + 20 * (i > 4))) for i in range(10)], "a double, b double"), ["a", "b"])
    model = segments.fit_kmeans(df, 2, starts=3)
    assert model.summary.trainingCost == pytest.approx(2 * 10 + 2 * 6 / 5) and model.getK() == model.summary.k == 2
    assert sorted(r["count"] for r in model.transform(df).groupBy("cluster").count().collect()) == model.summary.clusterSizes == [5, 5]


def test_nominal_codes_are_split_by_sets(spark):
    rows = [(i, i % 6, float(i % 5), int(i % 6 in (0, 2, 5))) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, code long, noise double, label int")
    fitted = models.train_forest(df, ["code"], trees=3, depth=1, nominal={"code": 6})
    assert fitted.score(df).filter("prediction != label").count() == 0
    boosted = models.train_boosting(df, ["code"], rounds=3, depth=1, nominal={"code": 6})
    assert boosted.score(df).filter("prediction != label").count() == 0
    by_order = models.train_forest(df, ["code"], trees=3, depth=1)
    assert by_order.score(df).filter("prediction != label").count() > 0
    # More codes than bins raise the bins, too many are refused; a feature left out does not count.
    assert models.train_forest(df, ["code"], trees=1, depth=1, bins=2, nominal={"code": 6, "noise": 9999}).score(df).count() == 300
    with pytest.raises(ValueError, match="9999 levels"):
        models.train_forest(df, ["code", "noise"], nominal={"noise": 9999})
    meta = assemble(df, ["noise", "code"], nominal={"code": 6}).schema["features"].metadata["ml_attr"]["attrs"]
    assert [a["num_vals"] for a in meta["nominal"]] == [6] and [a["name"] for a in meta["numeric"]] == ["noise"]


def test_placed_rows_give_the_same_model(spark):
    rng = np.random.default_rng(9)
    rows = [(i, *rng.normal(size=3).tolist(), int(rng.random() < 0.4)) for i in range(600)]
    schema = "id long, a double, b double, c double, label int"
    one = spark.createDataFrame(rows, schema).coalesce(1)
    many = spark.createDataFrame(rows[::-1], schema).repartition(13, "a")

    def parts(df):
        return [[r["id"] for r in p] for p in placed(df, "id", rows_per_part=100).rdd.glom().collect()]

    assert parts(one) == parts(many) and len(parts(one)) == 6 and placed(one.limit(0), "id").count() == 0
    names = ["a", "b", "c"]

    def scores(df, key):
        fitted = models.train_forest(df, names, trees=5, depth=4, key=key)
        return [r["score"] for r in fitted.score(one).orderBy("id").collect()]

    assert scores(one, "id") == scores(many, "id")
    assert scores(one, None) != scores(many, None)
    centres = [segments.fit_kmeans(assemble(df, names), 4, starts=2, max_iter=30, key="id").clusterCenters() for df in (one, many)]
    assert np.allclose(centres[0], centres[1], atol=1e-9)


def test_sweep_finds_planted_clusters(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 0.2, (40, 2)) for c in (0.0, 4.0, 8.0)])
    df = assemble(spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"])), ["a", "b"])
    sweep = segments.kmeans_sweep(df, range(2, 6), starts=2)
    inertia = [r["inertia"] for r in sweep.orderBy("k").collect()]
    assert inertia == sorted(inertia, reverse=True)
    assert segments.choose_k(sweep).head()["k"] == 3


def test_choose_k_ties(spark):
    sweep = spark.createDataFrame([(4, 1.0, 0.5), (3, 2.0, 0.5), (2, 3.0, 0.1)], "k int, inertia double, silhouette double")
    assert segments.choose_k(sweep).head()["k"] == 3


def test_segment_labels_have_strict_limits(spark):
    df = spark.createDataFrame([(15.1,), (15.0,), (10.0,)], "response_rate double")
    assert [r["segment"] for r in segments.label_clusters(df).collect()] == [segments.HIGH, segments.MODERATE, segments.LOW]


def test_clustered_rows_leave_most_cells_closed():
    rng = np.random.default_rng(7)
    middles = rng.uniform(-100, 100, (30, 8))
    train = np.concatenate([m + rng.normal(size=(100, 8)) for m in middles])
    centers = train[rng.permutation(len(train))[:55]]
    tree = pivots.PivotTree(centers)
    cell, dist = tree.nearest(train, np.ones(len(centers), bool))
    assert dist == pytest.approx(np.sqrt(((train[:, None] - centers) ** 2).sum(2)).min(axis=1))
    rows = np.bincount(cell, minlength=len(centers))
    radius = np.array([dist[cell == c].max(initial=0.0) for c in range(len(centers))])
    queries = train[::10] + rng.normal(size=(300, 8)) * 0.1
    home, _ = tree.nearest(queries, rows >= 5)
    every = np.sqrt(((queries[:, None] - train) ** 2).sum(2))
    bound = np.array([np.sort(every[i, cell == home[i]])[4] for i in range(300)])
    go = np.zeros((300, len(centers)), bool)
    for who, where in tree.open(queries, bound, home, radius, rows > 0):
        assert not go[who, where].any()
        go[who, where] = True
    assert go.mean() < 0.1
    # No neighbour is in a closed cell.
    best = np.argsort(every, axis=1)[:, :5]
    assert all(go[i, cell[j]] or cell[j] == home[i] for i in range(300) for j in best[i])


def test_pivot_search_holds_few_pairs_at_a_time():
    """Memory stays a few blocks however many pivots there are; any group of them may hold most."""
    rng = np.random.default_rng(8)
    centers = np.concatenate([rng.normal(size=(2500, 4)) * 0.01, rng.uniform(-50, 50, (500, 4))])
    rows = rng.uniform(-50, 50, (4000, 4))
    tree, every = pivots.PivotTree(centers), np.ones(len(centers), bool)
    tracemalloc.start()
    cell, dist = tree.nearest(rows, every)
    assert sum(len(who) for who, _ in tree.open(rows, dist, cell, np.full(len(centers), 5.0), every)) > 4000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * 8 * pivots.PAIRS < 8 * len(rows) * len(centers)
    assert dist[:50] == pytest.approx(np.sqrt(((rows[:50, None] - centers) ** 2).sum(2)).min(axis=1))


def test_hash_index_finds_most_and_compares_few(spark):
    """Clusters, a cell with a third of all rows, chunks much smaller than it: exact distances, recall as asked."""
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(20, 16)).repeat(30, axis=0) * 20 + rng.normal(size=(600, 16)), np.zeros((300, 16))])
    schema = "id long, v array<double>"
    train = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], schema)
    queries = spark.createDataFrame([(5000 + i, (x[i] + rng.normal(size=16) * 0.1).tolist()) for i in range(0, 900, 9)], schema)
    found = hashed.nearest_hashed(train, queries, 3, "id", "v", block=64).collect()
    q = {r["id"]: np.array(r["v"]) for r in queries.collect()}
    for r in found:
        assert r["distance"] == pytest.approx(np.sqrt(((q[r["query"]] - x[r["neighbour"]]) ** 2).sum()))
    hits = wanted = 0
    for i, v in q.items():
        d = np.sqrt(((x - v) ** 2).sum(1))
        best = set(np.lexsort((np.arange(len(x)), d))[:3].tolist())
        got = [r["neighbour"] for r in sorted(found, key=lambda r: r["rank"]) if r["query"] == i]
        assert len(got) == len(set(got)) <= 3
        hits, wanted = hits + len(best & set(got)), wanted + 3
    assert hits >= 0.9 * wanted
    h = hashed.fit_hasher(train, queries, 3, "id", "v", 8, 0.95, 42)
    a, b = h.codes(np.stack(list(q.values()))), h.codes(x)
    assert (a[:, None] == b[None]).any(axis=2).mean() < 0.25  # most rows are never compared


def test_hash_index_edges(spark):
    schema = "id long, v array<double>"
    one = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0])], schema)
    got = hashed.nearest_hashed(one, one, 5, "id", "v").orderBy("query", "rank").collect()
    assert [(r["query"], r["neighbour"], r["distance"]) for r in got] == [(1, 1, 0.0), (1, 2, 0.0), (2, 1, 0.0), (2, 2, 0.0)]
    assert hashed.nearest_hashed(one.limit(0), one, 5, "id", "v").count() == 0
    assert hashed.nearest_hashed(one, one.limit(0), 5, "id", "v").count() == 0
    truth = spark.createDataFrame([(1, 2), (1, 3)], "query long, neighbour long")
    assert hashed.recall_of(truth.limit(1), truth).head()["recall"] == 0.5


def test_meeting_probability_by_simulation():
    rng = np.random.default_rng(10)
    lines, shift = rng.normal(size=200_000), rng.uniform(0, 2.0, 200_000)
    for distance in (0.5, 2.0, 5.0):
        same = np.floor(shift / 2.0) == np.floor((lines * distance + shift) / 2.0)
        assert hashed.meet(np.array([distance]), 2.0, 1, 1)[0] == pytest.approx(same.mean(), abs=0.01)


def test_euclidean_silhouette_by_hand(spark):
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(c, 1.0, (30, 3)) for c in (0.0, 2.0)] + [np.full((1, 3), 9.0)])
    of = np.array([0] * 30 + [1] * 30 + [7])
    rows = [(f"r{i}", v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, of, strict=True))] + [("none", [0.0] * 3, None)]
    df = spark.createDataFrame(rows, "id string, v array<double>, c int").repartition(5)
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    want = []
    for i in range(61):
        own = (of == of[i]) & (np.arange(61) != i)
        near = min(d[i, of == c].mean() for c in set(of.tolist()) - {of[i]})
        want.append((near - d[i, own].mean()) / max(near, d[i, own].mean()) if own.any() else 0.0)
    got = {r["id"]: r["silhouette"] for r in silhouette.silhouettes(df, "id", "v", "c").collect()}
    assert [got[f"r{i}"] for i in range(61)] == pytest.approx(want) and len(got) == 61
    whole = silhouette.euclidean_silhouette(df, "id", "v", "c").head()
    assert (whole["silhouette"], whole["error"], whole["rows"]) == (pytest.approx(np.mean(want)), 0.0, 61)
    part = silhouette.euclidean_silhouette(df, "id", "v", "c", drawn=20).head()
    assert part["rows"] == 20 and abs(part["silhouette"] - np.mean(want)) < 4 * part["error"]
    assert silhouette.euclidean_silhouette(df.filter("c = 0"), "id", "v", "c").head()["silhouette"] is None
    assert silhouette.euclidean_silhouette(df.limit(0), "id", "v", "c").head()["rows"] == 0
