"""Quality rules: counts by hand, exact bounds, edge cases, the guarantee, the query beside its SQL."""

from __future__ import annotations

import glob
import math
import os
import random
import re

import duckdb
import pytest

from campaignlens.llm import ORACLES, QUERIES
from campaignlens.llm.rules import RULES, binomial_tail, judge, repeated_words, text_counts

SCHEMA = "doc_id long, lang string, text string, n_words string, kept string"


def repeats_by_hand(words, window=8):
    grams = [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]
    covered = {i + o for i, g in enumerate(grams) if grams.count(g) > 1 for o in range(window)}
    return len(covered)


def test_repeated_words_by_hand():
    rng = random.Random(1)
    texts = [[rng.choice([b"a", b"b"]) for _ in range(n)] for n in (0, 1, 7, 8, 9, 40, 60)]
    texts += [[b"x"] * 30, [b"p", b"q"] * 10, [str(i).encode() for i in range(30)] * 2]
    assert repeated_words(texts).tolist() == [repeats_by_hand(t) for t in texts]
    assert repeated_words([]).tolist() == []


def test_counts_by_hand():
    text = "# É|x \x1f\n\n same line \n same line \nSame line \n<é&"
    counts = {k: v.tolist() for k, v in text_counts([text, None, ""]).items()}
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    assert counts["n_words"] == [len(words), 0, 0] and counts["word_chars"] == [sum(map(len, words)), 0, 0]
    assert counts["n_symbols"] == [4, 0, 0] and counts["n_dup_lines"] == [1, 0, 0]
    assert counts["n_upper"] == [1, 0, 0] and counts["n_lines"] == [5, 0, 0]


@pytest.mark.parametrize("n,x,p", [(10, 0, 0.1), (10, 3, 0.7), (50, 2, 0.2), (200, 1, 0.0125), (5, 5, 0.5)])
def test_binomial_tail(n, x, p):
    exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(x + 1))
    assert binomial_tail(n, x, p) == pytest.approx(1.0 if x >= n * p else exact, rel=1e-9)
    assert binomial_tail(10**9, 10**6, 0.0125) < 1e-12


def table(spark, n, bad_share, seed=2):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() > bad_share
        words = [rng.choice("abcdefgh") * rng.randint(1, 9) + str(rng.randrange(999)) for _ in range(40)]
        if not good:
            words = [w + "###" for w in words]
        elif rng.random() < 0.004:
            words = [w + "#" for w in words[:8]] + words[8:]
        rows.append((i, "en" if i % 3 else None, " ".join(words), "x", "y"))
        labels.append((i, int(good)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int"), dict(labels)


def test_cutoffs_reject_junk_and_keep_the_guarantee(spark):
    docs, labels, quality = table(spark, 3600, 0.2)
    found = {r.doc_id: r for r in judge(docs, labels, risk=0.05, error=0.05).collect()}
    good = [r for k, r in found.items() if quality[k]]
    assert sum(not r.kept for r in good) <= 0.05 * len(good)
    assert not any(r.kept for k, r in found.items() if not quality[k])
    # No good document but one in 250 has symbols at all, so the strictest cutoff is safe for both strata.
    assert all(r.failed_rules == ["symbols"] for r in good if not r.kept)


def test_too_few_labels_reject_nothing(spark):
    docs, labels, _ = table(spark, 60, 0.5)
    assert all(r.kept for r in judge(docs, labels).collect())


def test_edge_cases(spark):
    long_text = " ".join(str(i) for i in range(50_000))
    rows = [(1, None, None, "x", "y"), (None, "en", "", None, None), (None, None, None, None, None), (2, "en", long_text, "x", "y"), (2, "en", long_text, "x", "y"), (3, "en", "a " * 40, "x", "y")]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(2, 1), (2, None), (None, 1), (7, 0)], "doc_id long, quality int")
    found = judge(docs, labels).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.kept) for r in found) == [(0, 0, False), (0, 0, False), (1, 0, False), (2, 50_000, True), (2, 50_000, True), (3, 40, False)]
    assert judge(docs.where("false"), labels).count() == 0
    assert judge(docs, labels.where("false")).count() == len(rows)


def test_query_agrees_with_sql(spark):
    directory, db = "/root/testdata/sf0.001", duckdb.connect()
    for path in glob.glob(f"{directory}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    df, sql = QUERIES["op7_quality_rules"](spark, directory), db.sql(ORACLES["op7_quality_rules"])
    names = sorted(df.columns)
    assert names == sorted(sql.columns)
    assert sorted(repr(tuple(r[c] for c in names)) for r in df.collect()) == sorted(map(repr, sql.select(*names).fetchall()))
    assert set(RULES) == {"symbols", "upper", "dup_lines", "repeats"}
