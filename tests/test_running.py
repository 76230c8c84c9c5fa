from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from campaignlens.operators import ranking
from campaignlens.operators.buckets import bucket_of, hot_share, quantile_splits
from campaignlens.operators.history import with_history
from campaignlens.operators.running import running


def table(n: int, kind: str) -> pd.DataFrame:
    rng = np.random.default_rng(7)
    x = {
        "unique": rng.permutation(n).astype(float),
        "one value holds a third": np.where(np.arange(n) % 3 == 0, 0.25, rng.random(n)),
        "all equal": np.full(n, 1.0),
        "few values": rng.integers(0, 3, n).astype(float),
    }[kind]
    return pd.DataFrame({"id": np.arange(n), "x": x, "w": rng.integers(1, 9, n)})


KINDS = ["unique", "one value holds a third", "all equal", "few values"]


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("descending", [False, True])
def test_running_matches_a_plain_sort(spark, kind, descending):
    pdf = table(700, kind)
    got = running(spark.createDataFrame(pdf), "x", {"total": F.col("w")}, descending, "id", parts=7).toPandas()
    pdf["draw"] = [hashlib.md5(f"0:{i}".encode()).hexdigest() for i in pdf["id"]]
    want = pdf.sort_values(["x", "draw"], ascending=[not descending, True]).reset_index(drop=True)
    want["total"], want["position"] = want["w"].cumsum(), want.index + 1
    want["before"] = want["x"].rank(method="min", ascending=not descending).astype(int) - 1
    got = got.sort_values("position").reset_index(drop=True)
    for c in ("id", "total", "position", "before"):
        assert got[c].tolist() == want[c].tolist()


def test_a_hot_value_has_its_own_buckets(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.rand(3)).alias("x"))
    splits, hot = quantile_splits(df, "x", 9)
    assert list(hot) == [0.5] and hot[0.5] >= 2
    placed = bucket_of(df, "x", splits, "b").withColumn("share", hot_share(splits, hot, "b"))
    sizes = placed.groupBy("b", "share").agg(F.count("*").alias("n"), F.countDistinct("x").alias("values")).collect()
    assert [(r["share"], r["values"]) for r in sizes if r["share"] > 1] == [(hot[0.5], 1)]
    assert max(r["n"] / r["share"] for r in sizes) < 2 * 4000 / 9


def test_null_order_values_are_left_out(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None)], "id int, x double")
    assert [r["id"] for r in running(df, "x", {}, key="id").collect()] == [1]


def test_ranks_match_pandas(spark):
    pdf = table(101, "few values")
    got = ranking.rank_prospects(spark.createDataFrame(pdf), "x", "id", tiles=4).toPandas()
    sizes = got.groupby("tile")["id"].count().tolist()
    assert sizes == [26, 25, 25, 25]
    want = (pdf.set_index("id")["x"].rank(method="min", ascending=False) - 1) / 100
    assert got.set_index("id")["percent_rank"].sort_index().tolist() == pytest.approx(want.tolist())


def test_more_tiles_than_rows(spark):
    got = ranking.rank_prospects(spark.createDataFrame(table(3, "unique")), "x", "id", tiles=5).collect()
    assert sorted(r["tile"] for r in got) == [1, 2, 3]


def test_rows_to_reach_counts_an_exact_prefix_as_short(spark):
    df = spark.createDataFrame([("a", 8.0), ("b", 1.0), ("c", 1.0)], "k string, v double")
    shares = ranking.cumulative_share(df, "k", "v")
    assert [r["rows"] for r in ranking.rows_to_reach(shares, [0.8, 0.7]).collect()] == [2, 1]


def test_sort_by_size(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", -3.0), ("c", 3.0)], "k string, v double")
    assert [r["k"] for r in ranking.sort_by_size(df, "v", "k").collect()] == ["b", "c", "a"]


@pytest.mark.parametrize("crowded", [False, True])
def test_hot_clients_get_the_same_history(spark, crowded):
    rng = np.random.default_rng(2)
    n = 900
    client = np.where(np.arange(n) % 3 == 0, 1, rng.integers(2, 60, n))
    day = np.where(np.arange(n) % 2 == 0, 5, rng.integers(0, 40, n)) if crowded else rng.integers(0, 4000, n)
    pdf = pd.DataFrame({
        "id": rng.permutation(n), "client": client, "outcome": rng.choice(["x", "y"], n),
        "t": pd.Timestamp("2024-01-01") + pd.to_timedelta(day, unit="D"),
    })
    df = spark.createDataFrame(pdf).withColumn("t", F.col("t").cast("timestamp_ntz"))
    args = (df, "client", "t", "id", "outcome")
    plain = with_history(*args, hot_rows=10**9).orderBy("id").collect()
    sliced = with_history(*args, hot_rows=50).orderBy("id").collect()
    assert plain == sliced
    pdf = pdf.sort_values(["client", "t", "id"])
    pdf["previous"] = pdf.groupby("client").cumcount()
    pdf["poutcome"] = pdf.groupby("client")["outcome"].shift().fillna("unknown")
    gap = (pdf["t"] - pdf.groupby("client")["t"].shift()).dt.days.fillna(-1)
    pdf["pdays"] = gap.astype(int)
    want = pdf.sort_values("id")[["previous", "pdays", "poutcome"]].values.tolist()
    assert [[r["previous"], r["pdays"], r["poutcome"]] for r in plain] == want


def test_whole_numbers_that_share_a_double(spark):
    big = 2**53
    values = [big, big, big + 1, big + 2, big + 3] + [big + 1] * 400 + [big] * 400 + [5]
    df = spark.createDataFrame(list(enumerate(values)), "id long, v long")
    rows = running(df, "v", {"n": F.lit(1)}, key="id").collect()
    assert {(r["v"], r["before"]) for r in rows} == {(v, sum(x < v for x in values)) for v in values}
    assert sorted(r["position"] for r in rows) == list(range(1, len(values) + 1))
    assert [r["v"] for r in sorted(rows, key=lambda r: r["position"])] == sorted(values)
    down = running(df, "v", {"n": F.lit(1)}, key="id", descending=True).collect()
    assert [r["v"] for r in sorted(down, key=lambda r: r["position"])] == sorted(values, reverse=True)


def test_history_of_very_many_rows_without_a_client(spark):
    rows = [(i, None if i % 3 else 7, i // 2, f"o{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, c long, d int, o string").withColumn("t", F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, d)")).drop("d")
    from campaignlens.operators.history import hot_keys, with_history

    assert {r[0] for r in hot_keys(df, "c", 90).collect()} == {None, 7}
    whole, sliced = (with_history(df, "c", "t", "id", "o", hot_rows=n).collect() for n in (10**6, 90))
    assert sorted(map(repr, whole)) == sorted(map(repr, sliced))


@pytest.mark.parametrize("share", [0.0, 0.01, 0.3, 0.999, 1.0])
def test_share_by_threshold_takes_the_rows_of_the_ranks(spark, share):
    rows = [(i, [0.5, 0.5, 0.5, float(i % 11), -float(i), None][i % 6]) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, x double")
    chosen = ranking.choose_share(df, "x", "id", share)
    ranked = ranking.top_share(df.where("x IS NOT NULL"), "x", "id", share)
    assert sorted(map(tuple, chosen.collect())) == sorted((r["id"], r["x"]) for r in ranked.collect())
    assert "Window" not in chosen._jdf.queryExecution().executedPlan().toString()


def test_kth_largest(spark):
    values = [float(v) for v in [3, 3, 3, 1, 2, 9, 9, -5, 0, 0] + list(range(100, 900))]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 2, 400, 801, 803, 806, 810):
        assert ranking.kth_largest(df, "x", k) == sorted(values, reverse=True)[k - 1]
    assert ranking.kth_largest(df, "x", 811) is None and ranking.kth_largest(df.limit(0), "x", 1) is None
