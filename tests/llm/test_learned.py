"""The trained operators: brute force of their parts, edge cases, held-out accuracy of the queries."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from campaignlens.llm import cnn, crf, learned_queries
from campaignlens.llm.language import fit_language, predict_language
from campaignlens.llm.quality import fit_quality, fold, score_quality

DIRECTORY = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, score string, lang_pred int"
ODD = [
    (1, None, "en", "x", 1),
    (2, "", None, None, None),
    (None, "word words", "en", "x", 1),
    (None, None, None, None, None),
    (3, "12 | 34 !!", "en", "x", 1),
    (4, "the " * 40_000, "en", "x", 1),
    (5, "x" * 70_000, "xx", "x", 1),
    (6, "the cat", "en", "x", 1),
    (6, "the cat", "en", "x", 1),
]


@pytest.mark.parametrize("n,k,starts", [(1, 2, [0]), (5, 3, [0]), (6, 2, [0, 3]), (7, 2, [0, 1, 2])])
def test_forward_backward_by_enumeration(n, k, starts):
    rng = np.random.default_rng(n)
    evidence, jump, begin = rng.normal(size=(n, k)), rng.normal(size=(k, k)), rng.normal(size=k)
    total = np.zeros((n, k))
    for y in itertools.product(range(k), repeat=n):
        s = sum(evidence[t, y[t]] + (begin[y[t]] if t in starts else jump[y[t - 1], y[t]]) for t in range(n))
        for t in range(n):
            total[t, y[t]] += np.exp(s)
    assert np.allclose(total / total.sum(1, keepdims=True), crf.forward_backward(evidence, np.array(starts), jump, begin))


def test_features_of_a_word_do_not_depend_on_its_neighbours():
    words = ["a", "", "été", "straße", "x" * 200, "ab"]
    together, starts = crf.features(words)
    ends = [*starts[1:], len(together)]
    for word, a, b in zip(words, starts, ends, strict=True):
        assert together[a:b].tolist() == crf.features([word])[0].tolist()


def test_cached_words_have_the_same_evidence():
    tagger = crf.train([["the", "cat"], ["le", "chat"]], [[0, 0], [1, 1]], ["en", "fr"], {"the": 0})
    first = tagger.evidence(["the", "zebra", "12", "the"])
    again = tagger.evidence(["12", "the", "zebra"])
    assert np.allclose(first[0][[2, 0, 1]], again[0]) and first[1].tolist() == [True, True, False, True]


def test_long_words_are_runs_with_every_trigram():
    rng = random.Random(3)
    for n in (0, 1, 3, 64, 65, 66, 67, 126, 127, 10_000):
        word = "".join(rng.choice("abcdefgh") for _ in range(n))
        runs = crf.in_runs(word)
        assert all(len(r) <= crf.RUN for r in runs) and min(map(len, runs)) > min(n - 1, 16)
        assert runs[0] + "".join(r[2:] for r in runs[1:]) == word
    assert crf.cut(["ab", "-" * 70, "x,y" * 30]) == ["ab", "", *crf.in_runs("xy" * 30)]


def test_the_middle_of_a_long_word_decides_its_language(spark):
    rng = random.Random(5)
    letters = {"en": "thecarun", "fr": "êéèàoùqç"}
    many = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    ends = many("xyz", 3_000), many("xyz", 3_000)
    word = lambda lang: ends[0] + many(letters[lang], 4_000) + ends[1]
    schema = "doc_id long, text string, lang string"
    short = [(i, " ".join(many(letters[lang], 5) for _ in range(30)), lang) for i, lang in enumerate(["en", "fr"] * 30)]
    long = [(i, word(lang), lang) for i, lang in enumerate(["en", "fr"] * 30)]
    asked = spark.createDataFrame([(i, word(lang), lang) for i, lang in enumerate(["en", "fr"] * 4)], schema)
    for learn in (short, long):
        tagger = fit_language(spark.createDataFrame(learn, schema))
        assert all(r.lang == r.lang_pred for r in predict_language(asked, tagger).collect())
    change = [(1, many(letters["en"], 5_000) + many(letters["fr"], 3_000) + many(letters["en"], 5_000))]
    row = predict_language(spark.createDataFrame(change, "doc_id long, text string"), tagger, labels_col="words").first()
    assert row.lang_pred == "en" and row.n_switches == 2 and len(row.words) == len(crf.in_runs("x" * 13_000))


def test_repeats_by_hand():
    rng = random.Random(4)
    data = bytes(rng.choice(b"ab") for _ in range(300)) + b"0123456789" * 3
    found = cnn.repeats(np.frombuffer(data, np.uint8))
    for t in range(len(data)):
        back = data.rfind(data[t : t + 8], 0, t + 7) if t + 8 <= len(data) else -1
        assert found[t] == (0 if back < 0 else min(int(np.log2(t - back)) + 1, cnn.BUCKETS - 1))


@pytest.mark.parametrize("settings", [{}, {"piece": 10_000}, {"piece": 10_000, "held": 30_000}])
def test_repeats_by_hand_in_long_texts(settings):
    rng = random.Random(6)
    passage = bytes(rng.randrange(256) for _ in range(500))
    near = b"".join(rng.choice([b"alpha ", b"beta ", b"gamma "]) for _ in range(6_000))
    data = passage + bytes(rng.randrange(256) for _ in range(60_000)) + passage + near + b"a" * 40_000 + passage
    assert len(data) > 100_000
    last, wanted = {}, []
    for t in range(len(data)):
        back = t - last.get(data[t : t + 8], t) if t + 8 <= len(data) else 0
        wanted.append(min(int(np.log2(back)) + 1, cnn.BUCKETS - 1) if back else 0)
        last[data[t : t + 8]] = t
    found = cnn.repeats(np.frombuffer(data, np.uint8), **settings)
    assert found.tolist() == wanted and {16, 17, 0, 1} <= set(wanted)


def test_distances_that_no_example_had_count_as_the_next_smaller():
    texts = [b"0123456789" * 3, b"abcdefghij" * 4]
    net = cnn.train(texts, np.array([0.0, 1.0]), np.ones(2), filters=3, hidden=3, steps=3)
    assert all((net.back[:, b] == net.back[:, 4]).all() for b in range(5, cnn.BUCKETS))


def test_network_by_hand_and_its_gradients():
    rng = random.Random(1)
    texts = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 5, 255, 256, 900, 2600)]
    net = cnn.Network.fresh(3, 4, 2)
    for p in net.parts():
        p += np.random.default_rng(5).normal(size=p.shape).astype(np.float32) * 0.1
    together = net.scores(texts)
    for text, score in zip(texts, together, strict=True):
        n = (len(text) + 8 + 255) // 256
        rest = n * 256 - len(text)
        data, back = bytes(8) + text + bytes(rest), [*[0] * 8, *cnn.repeats(np.frombuffer(text, np.uint8)), *[0] * rest]
        cells = []
        for c in range(n):
            outs = [
                sum(net.taps[k, data[t + k]] for k in range(8)) + sum(net.back[j, back[t + tap]] for j, tap in enumerate(cnn.TAPS))
                for t in range(c * 256, c * 256 + 256, 4)
            ]
            cells.append(np.maximum(np.max(outs, axis=0) + net.bias, 0))
        chunks = [np.maximum(cells[i], cells[min(i + 1, n - 1)]) for i in range(n)]
        hidden = [np.maximum(c @ net.dense + net.dense_bias, 0) for c in chunks]
        logit = np.max(hidden, axis=0) @ net.out[0] + np.mean(hidden, axis=0) @ net.out[1] + net.out_bias[0]
        assert score == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-5) == net.scores([text])[0]
    target, weight = np.array([0, 1, 0, 1, 0, 1.0]), np.full(6, 1 / 6)
    args = cnn.padded(texts)

    def loss():
        p = np.clip(net.forward(*args)[0].astype(float), 1e-7, 1 - 1e-7)
        return -(weight * (target * np.log(p) + (1 - target) * np.log(1 - p))).sum()

    grads = net.gradients(*args, target, weight)
    for p, g in zip(net.parts(), grads, strict=True):
        for i in np.argsort(-np.abs(g).ravel())[:3]:
            kept = p.ravel()[i]
            p.ravel()[i] = kept + 1e-2
            up = loss()
            p.ravel()[i] = kept - 1e-2
            down = loss()
            p.ravel()[i] = kept
            assert (up - down) / 2e-2 == pytest.approx(g.ravel()[i], rel=0.15, abs=2e-3)


def test_language_edge_cases(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    rng = random.Random(2)
    words = {"en": ["the", "cat", "runs", "here"], "fr": ["être", "où", "quand", "les"]}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    learn = spark.createDataFrame([(i, text("en" if i % 2 else "fr", 30), "en" if i % 2 else "fr") for i in range(60)], "doc_id long, text string, lang string")
    tagger = fit_language(learn)
    found = predict_language(docs, tagger, labels_col="words").collect()
    assert docs.columns + ["lang_pred_", "score_", "n_switches", "words"] == list(found[0].asDict())
    by = {(r.doc_id, r.text): r for r in found}
    assert len(found) == len(ODD)
    for key, t in ((1, None), (2, ""), (None, None), (3, "12 | 34 !!")):
        assert (by[key, t].lang_pred_, by[key, t].score_) == ("und", 0.0)
    assert by[4, "the " * 40_000].lang_pred_ == "en" and len(by[4, "the " * 40_000].words) == 40_000
    assert all(0 <= r.score_ <= 1 for r in found)
    mixed = spark.createDataFrame([(1, text("en", 30) + " " + text("fr", 12))], "doc_id long, text string")
    row = predict_language(mixed, tagger, labels_col="words").first()
    assert row.lang_pred == "en" and row.n_switches == 1 and row.words == ["en"] * 30 + ["fr"] * 12
    nothing = fit_language(docs.where("false"))
    assert {r.lang_pred_ for r in predict_language(docs, nothing).collect()} == {"und"}
    assert predict_language(docs.where("false"), tagger).count() == 0
    assert fit_language(docs).labels == ["en", "xx"]


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 0), (5, 1), (6, 1), (6, 0), (None, 1), (3, None), (4, 7)], "doc_id long, quality int")
    net = fit_quality(docs, labels, steps=5)
    found = score_quality(docs, net)
    assert found.columns == [*docs.columns, "score_"]
    rows = found.collect()
    assert len(rows) == len(ODD) and all(0 <= r.score_ <= 1 for r in rows)
    assert len({r.score_ for r in rows if not r.text}) == 1 and len({r.score_ for r in rows if r.doc_id == 6}) == 1
    empty = fit_quality(docs, labels.where("false"))
    assert {r.score_ for r in score_quality(docs, empty).collect()} == {0.5}
    assert score_quality(docs.where("false"), net).count() == 0


def test_examples_of_a_repeated_id_are_bounded_and_weighted(spark, monkeypatch):
    from campaignlens.llm import quality

    given = []
    monkeypatch.setattr(quality, "train", lambda texts, target, weights, **_: given.append((texts, target, weights)))
    rows = [(1, "same")] * 50 + [(2, f"text {i}") for i in range(400)] + [(3, "a"), (4, "b"), (4, "b"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 1), (5, 1)], "doc_id long, quality int")
    fit_quality(docs, labels, max_per_label=100)
    texts, target, weights = given[0]
    good = {t: w for t, y, w in zip(texts, target, weights, strict=True) if y}
    assert good == {b"same": 50, b"a": 1, b"b": 2, b"": 1}
    assert 50 < len(texts) - len(good) < 150
    assert all(w == 4 for y, w in zip(target, weights, strict=True) if not y)


def test_language_query_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{DIRECTORY}/documents.parquet")
    found = learned_queries.op4_language_id(spark, DIRECTORY)
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score", "n_switches"]
    rows = found.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out]
    assert 0.2 < len(held) / len(rows) < 0.3
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.98


def test_quality_query_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{DIRECTORY}/{t}.parquet") for t in ("documents", "labels"))
    found = learned_queries.op6_quality_classifier(spark, DIRECTORY)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    assert found.count() == docs.count() and found.where(F.col("predicted") != (F.col("score") >= 0.3).cast("int")).count() == 0
    held = found.where("held_out").join(labels, "doc_id").collect()
    good, junk = [r.score for r in held if r.quality], [r.score for r in held if not r.quality]
    assert np.mean([s >= 0.3 for s in good]) > 0.98
    assert np.mean([a > b for a in good for b in junk]) > 0.95
    assert spark.range(1).select(fold("id", 5)).first()[0] == __import__("zlib").crc32(b"0") % 5


def test_windows_give_the_chances_of_whole_texts(monkeypatch):
    rng = np.random.default_rng(5)
    labels = [f"l{i}" for i in range(7)]
    tagger = crf.Tagger(labels, rng.normal(size=(crf.BUCKETS + 8, 7)) / 3, rng.normal(size=(7, 7)), rng.normal(size=7))
    words = ["the", "chat", "12", "und", "x" * 300, "né", "a|b"]
    for size in (0, 1, 2, 300, 3000):
        text = "  ".join(random.Random(size).choices(words, k=size)) + "  "
        ((split, lettered, chances),) = tagger.tag([text])
        for window in (1, 50, 1000, 1 << 20):
            monkeypatch.setattr(crf.Tagger, "window", window)
            parts = list(tagger.tag_windows(text))
            assert [w for p in parts for w in p[0]] == split
            if size:
                assert np.allclose(np.concatenate([p[2] for p in parts]), chances)
                assert np.concatenate([p[1] for p in parts]).tolist() == lettered.tolist()


def plain_prediction(tagger, text):
    """Word by word, matrices written out: language, score, changes."""
    words = [r for w in (text or "").split() for r in (crf.in_runs(w) if len(w) > crf.RUN else [w])]
    k = len(tagger.labels)
    bare = [crf.letters(w) for w in words]
    if not any(bare):
        return "und", 0.0, 0
    rows = []
    for b in bare:
        own = np.zeros(k)
        if b:
            own += tagger.weights[crf.features([b])[0]].sum(axis=0) + tagger.weights[crf.BUCKETS + tagger.lexicon.get(b, k)]
        rows.append(own)
    ahead = [tagger.begin + rows[0]]
    for row in rows[1:]:
        ahead.append(np.logaddexp.reduce(ahead[-1][:, None] + tagger.jump, axis=0) + row)
    back = [np.zeros(k)]
    for row in rows[:0:-1]:
        back.append(np.logaddexp.reduce(tagger.jump + (row + back[-1])[None, :], axis=1))
    chances = [np.exp(a + b - np.logaddexp.reduce(a + b)) for a, b in zip(ahead, back[::-1], strict=True)]
    chances = np.array([c for c, b in zip(chances, bare, strict=True) if b])
    mean = chances.mean(axis=0)
    likely = chances.argmax(axis=1).tolist()
    return tagger.labels[int(mean.argmax())], float(mean.max()), sum(a != b for a, b in zip(likely, likely[1:], strict=False))


def test_language_query_against_a_plain_prediction(spark):
    directory = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{directory}/documents.parquet").select("doc_id", "text", "lang")
    tagger = fit_language(docs, learn=F.coalesce(fold("doc_id", 4) != 2, F.lit(True)))
    found = {r.doc_id: r for r in learned_queries.op4_language_id(spark, directory).collect()}
    rows = docs.collect()
    assert set(found) == {r.doc_id for r in rows}
    for r in rows:
        lang, score, changes = plain_prediction(tagger, r.text)
        own = found[r.doc_id]
        assert own.lang_pred == lang and abs(own.score - score) < 1e-9 and own.n_switches == changes


def test_the_language_sample_is_bounded_by_pairs_of_id_and_text(spark, monkeypatch):
    from campaignlens.llm import language

    seen = []
    monkeypatch.setattr(language, "train", lambda chains, targets, *rest: seen.append((chains, targets)) or crf.train(chains, targets, *rest, rounds=2))
    rows = [(7, "un chat noir dort ici", "fr")] * 3000 + [(None, f"the cat {i} sleeps", "en") for i in range(3000)]
    fit_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_docs=50)
    (chains, targets), *_ = seen
    spans = [y for t in targets for y in t]
    assert {0, 1} == set(spans) and len([1 for t in targets for _ in t]) < 50 * 6 * 10 * 3


def test_many_labels_and_long_texts_stay_small():
    import tracemalloc

    labels = [f"l{i:02d}" for i in range(60)]
    rng = np.random.default_rng(1)
    tagger = crf.Tagger(labels, rng.normal(size=(crf.BUCKETS + 61, 60)) / 9, rng.normal(size=(60, 60)), rng.normal(size=60))
    text = "the quick brown fox " * 60_000
    tracemalloc.start()
    total = sum(len(words) for words, _, _ in tagger.tag_windows(text))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == 240_000 and peak < 200 << 20
