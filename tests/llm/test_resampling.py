"""Importance resampling: features, cutoffs and ranks against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from campaignlens.llm import resampling
from campaignlens.llm.resampling import cutoff, features, gains, resample, smallest, windows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_by_hand(text):
    return WORD.findall((text or "").translate(UPPER))


def features_by_hand(text, buckets, longest=3):
    words = words_by_hand(text)
    return [
        zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(words) - n + 1)
    ]


def texts():
    rng = random.Random(5)
    letters = "abÄé日 Z9_-@\n\x00`{Ω "
    return ["", " ", "a", "a b", "A,b;C", "Ünï 日本 x", "x" * 50, *("".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(300))]


@pytest.mark.parametrize("window", [1, 5, 1 << 20])
@pytest.mark.parametrize("longest", [1, 2, 3, 4])
def test_features(monkeypatch, window, longest):
    monkeypatch.setattr(resampling, "windows", lambda data: windows(data, window))
    for text in texts():
        parts = list(features(text.encode(), 997, longest))
        found = [int(b) for _, part in parts for b in part]
        assert sorted(found) == sorted(features_by_hand(text, 997, longest)), text
        assert sum(n for n, _ in parts) == len(words_by_hand(text))
    assert list(features(None, 10)) == []


def test_smallest(spark):
    rng = random.Random(1)
    for high in (0, 3, 40, 10**6, (1 << 63) - 1):
        values = sorted([rng.randint(-high, high) for _ in range(50)] + [0] * 10)
        table = spark.createDataFrame([(v,) for v in values], "v long").coalesce(1).cache()
        for wanted in (1, 17, 30, 60):
            assert smallest(table, "v", wanted, values[0], values[-1]) == values[wanted - 1]
        assert smallest(table, "v", 61, values[0], values[-1]) == values[-1]


def test_cutoff_at_every_level(spark):
    rng = random.Random(2)
    rows = [(rng.choice([5, 5, 5, -3, 10**12]), rng.choice([1, 1, 2, 9, (1 << 63) - 1]), i << 20) for i in range(60)]
    table = spark.createDataFrame(rows, "score long, id_key long, place long").coalesce(1).cache()
    order = sorted(rows, key=lambda r: (-r[0], r[1], r[2]))
    for wanted in (1, 2, 7, 30, 43, 59, 60):
        assert sorted(map(tuple, table.where(cutoff(table, wanted)).collect())) == sorted(order[:wanted])


def by_hand(rows, target, percent, min_words, buckets, seed=42):
    s, t = (
        np.bincount(np.array([b for x in side for b in features_by_hand(x, buckets)], int), minlength=buckets)
        for side in ([x for _, x in rows], target)
    )
    s_all, t_all = int(s.sum()), int(t.sum())
    gain = [math.floor(1000 * math.log((int(t[b]) + 1) * (s_all + buckets) / ((int(s[b]) + 1) * (t_all + buckets)))) for b in range(buckets)]
    out = []
    for at, (key, text) in enumerate(rows):
        found = features_by_hand(text, buckets)
        weight = sum(gain[b] for b in found)
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((key, len(found), weight, score, len(words_by_hand(text)), at))
    able = sorted((r for r in out if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {r[5]: i + 1 for i, r in enumerate(able[: len(able) * percent // 100])}
    return [(*r[:4], rank.get(r[5])) for r in out]


@pytest.mark.parametrize("percent", [0, 5, 50, 100])
def test_resample(spark, percent):
    rng = random.Random(9)
    words = ["alpha", "beta", "gamma", "Ünit", "x9", "日本", *(f"w{i}" for i in range(40))]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(200)] + [(1000 - i, "same words " * 15) for i in range(40)]
    rows += [(300, None), (301, ""), (302, "long tail " * 200_000)]
    target = ["alpha beta gamma", "Alpha, beta!", None, ""]
    docs = spark.createDataFrame([(k, t, 7, "x") for k, t in rows], "doc_id long, text string, score int, rank string").repartition(5)
    found = resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent, 20, 101)
    assert found.columns == ["doc_id", "score", "rank", "n_words", "n_features", "weight", "score_", "rank_"]
    own = sorted((r.doc_id, r.n_features, r.weight, r.score_, r.rank_) for r in found.collect())
    assert [r[:4] for r in own] == sorted(r[:4] for r in by_hand(rows, target, percent, 20, 101))
    assert own == sorted(by_hand(rows, target, percent, 20, 101), key=lambda r: r[:4])


def test_repeated_and_missing_ids(spark):
    rows = [(1, "same text here")] * 30 + [(None, "same text here")] * 30 + [(2, "other")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = resample(docs, spark.createDataFrame([("same text",)], "text string"), 50, 0, 11).collect()
    assert len(found) == 65 and sorted(r["rank"] for r in found if r["rank"]) == list(range(1, 33))
    expected = by_hand(rows, ["same text"], 50, 0, 11)
    assert sorted(map(repr, ((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in found))) == sorted(map(repr, expected))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = resample(docs, some)
    assert none.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"] and none.count() == 0
    assert resample(some, docs, 100, 0).select("rank").first()[0] == 1
    assert set(gains(np.zeros(5, np.int64), np.zeros(5, np.int64))) == {0}


def test_query(spark):
    from campaignlens.llm.resampling_queries import op12_importance_resampling

    directory = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{directory}/documents.parquet").orderBy("doc_id").collect()]
    target = [r.text for r in spark.read.parquet(f"{directory}/benchmark.parquet").collect()]
    found = op12_importance_resampling(spark, directory)
    assert sorted(map(tuple, found.collect())) == sorted(by_hand(rows, target, 5, 20, 10_000))
    assert found.where(F.col("rank").isNotNull()).count() == 5 * sum(len(words_by_hand(t)) >= 20 for _, t in rows) // 100
