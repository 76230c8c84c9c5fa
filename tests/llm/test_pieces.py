"""SentencePiece: the segmentation against plain dynamic programming, exact round trips, edge cases."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from campaignlens.llm import pieces, token_queries
from campaignlens.llm.pieces import MARK, REAL_MARK, PieceModel, are_ranks, decode_ids, encode_texts

PATH = "/opt/tokenizers/piece_bpe_32k.model"
ODD = ["", " ", "a", "  a", "a  b ", "a\n\nb\tc", "ﬁ Ａ é", "😀\u0000 x", f"{MARK}x {MARK}", "日本語 テスト", " " * 40 + "z", "x" * 5000, "ab " * 9000, "\U0010ffff"]


@pytest.fixture(scope="module")
def model():
    return PieceModel.load(PATH)


def best_by_hand(model, text):
    """Viterbi over the whole text, not over words; the score of the best segmentation and its ids."""
    score_of = dict(zip((model.pieces[i] for i in model.ids), model.scores, strict=True))
    id_of = {model.pieces[i]: int(i) for i in model.ids}
    s = MARK + text.replace(MARK, REAL_MARK).replace(" ", MARK)
    best, back = [0.0] + [-1e300] * len(s), [0] * (len(s) + 1)
    for e in range(1, len(s) + 1):
        for b in range(max(0, e - model.longest), e):
            score = score_of.get(s[b:e], model.unknown_score if e - b == 1 else None)
            if score is not None and best[b] + score > best[e]:
                best[e], back[e] = best[b] + score, b
    ids, e = [], len(s)
    while e:
        piece = s[back[e] : e]
        ids = ([id_of[piece]] if piece in id_of else model._fallback(piece).tolist()) + ids
        e = back[e]
    return ids


def encoded(model, texts):
    ids, offsets = model.encode(texts)
    return [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)]


def test_segmentation_by_hand(model):
    rng = random.Random(6)
    texts = [t for t in ODD if t and len(t) < 300]
    texts += ["".join(rng.choice("theandriong é\n#") for _ in range(rng.randint(1, 60))) for _ in range(150)]
    for text, ids in zip(texts, encoded(model, texts), strict=True):
        assert ids == best_by_hand(model, text), text
    assert encoded(model, texts) == encoded(PieceModel.load(PATH), texts)


def test_never_more_pieces_than_merging(spark, model):
    """The library's own encoding is one of the segmentations, so none of ours has more pieces."""
    own = SentencePieceProcessor(model_file=PATH)
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    texts = [t for t in (r.text for r in rows) if t and own.decode(own.encode(t)) == t]
    ours, merged = encoded(model, texts), [own.encode(t) for t in texts]
    assert len(texts) > 50 and all(len(a) <= len(b) for a, b in zip(ours, merged, strict=True))
    assert [model.pieces[i] for i in encoded(model, ["the quick brown"])[0]] == ["▁the", "▁quick", "▁brown"]


def test_ranks_are_told_from_probabilities():
    assert are_ranks(np.array([0.0, -2, -1])) and are_ranks(np.array([-1.0, -9, -9])) and not are_ranks(np.array([-1.5, -2.25])) and not are_ranks(np.array([-1.0, -1.0]))


def test_round_trip(model):
    rng = random.Random(7)
    texts = ODD + ["".join(chr(rng.choice([32, 10, 97, 0x2581, 0xE9, 0x4E00, 0x1F600])) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    for text, ids in zip(texts, encoded(model, texts), strict=True):
        assert model.decode(ids) == text
    assert encoded(model, []) == []


def test_tables(spark, model):
    rows = [(i, t, "x", 1) for i, t in enumerate([*ODD, None, ODD[5]])] + [(None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int")
    table = encode_texts(docs, model)
    assert table.columns == [*docs.columns, "ids_"]
    back = decode_ids(table, model, "ids_")
    assert back.columns == [*docs.columns, "ids_", "decoded_"]
    found = back.collect()
    assert len(found) == len(rows) and all(r.text == r.decoded_ for r in found)
    assert all((r.ids_ is None) == (r.text is None) for r in found) and [r.ids_ for r in found if r.text == ""] == [[]]
    assert encode_texts(docs.where("false"), model).count() == 0


def test_decoding_in_runs(spark, model, monkeypatch):
    """Rows, nulls among them, come back whole however few ids are decoded at a time."""
    texts = ["a b c " * 50, "", None, "x", "y z " * 80, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(pieces, "IDS_AT_A_TIME", 7)
    table = pa.Table.from_batches(list(_runs(encode_texts(docs, model), model)))
    assert table["decoded"].to_pylist() == texts and table["doc_id"].to_pylist() == list(range(6))


def _runs(table, model):
    """What decode_ids does with batches, in this process, where a bound can be changed."""
    caught = []

    class Table:
        columns, schema = table.columns, table.schema

        def mapInArrow(self, run, schema):
            caught.append(run)

    decode_ids(Table(), model)
    batches = list(caught[0](table.orderBy("doc_id").toArrow().combine_chunks().to_batches()))
    assert len(batches) > 3
    return batches


def test_query(spark):
    found = token_queries.op5_sentencepiece(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert found.columns == ["doc_id", "ids", "n_tokens", "round_trip"]
    assert found.count() == docs.count() and found.where("NOT round_trip OR n_tokens <> size(ids)").count() == 0
    model = PieceModel.load(PATH)
    for r in found.join(docs, "doc_id").where(F.length("text") < 1500).limit(25).collect():
        assert r.ids == best_by_hand(model, r.text)
