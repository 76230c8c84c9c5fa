"""Packing: pieces against plain encoding, numbering without gaps, edge cases."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from campaignlens.llm import packing
from campaignlens.llm.byte_pairs import WINDOW, BytePairs, windows, words_of
from campaignlens.llm.packing import binary_lengths, pack_documents
from campaignlens.llm.packing_queries import op13_power_of_two_packing

PATH = "/opt/tokenizers/byte_bpe_50k.json"
ODD = ["", " ", "a", "  a", " a", "a  b ", "a\n\nb\tc d", "x y z", "a  b", "don't 12 3%", "\x1c a \x1c", "日本語 テスト", "😀\u0000 x", "x" * 3000, "<|endoftext|> a <|endoftext|>b"]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def encoded(encoder, texts):
    ids, offsets = encoder.encode(texts)
    return [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)]


def test_words_give_the_ids_of_whole_texts(plain):
    rng = random.Random(3)
    letters = "the quick's  \n\t  ᠎\x1f9%é日!"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(2000)]
    encoder = BytePairs.load(PATH)
    expected = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert encoded(encoder, texts) == expected and encoded(encoder, texts) == expected
    assert encoded(encoder, []) == []
    literal = Tokenizer.from_file(PATH)
    literal.encode_special_tokens = True
    own = encoded(BytePairs.load(PATH, plain=True), texts)
    assert own == [literal.encode(t, add_special_tokens=False).ids for t in texts] != expected
    named = BytePairs.load(PATH).token_bytes()
    assert [b"".join(named[i] for i in x) for x in own] == [t.encode() for t in texts]


def test_long_texts_are_read_in_windows(plain):
    text = "word and  more, " * (WINDOW // 8)
    parts = list(windows(text))
    assert len(parts) > 1 and " ".join(parts) == text and " ".join(words_of(text)) == text
    assert encoded(BytePairs.load(PATH), [text, "a"]) == [plain.encode(text, add_special_tokens=False).ids, plain.encode("a").ids]
    assert list(windows("x" * 50, 10)) == ["x" * 50]


def test_binary_lengths():
    lengths, pieces = binary_lengths(np.array([1, 8, 13, 1024, 3000]), 1024)
    assert lengths.tolist() == [1, 8, 8, 4, 1, 1024, 1024, 1024, 512, 256, 128, 32, 16, 8]
    assert pieces.tolist() == [1, 1, 3, 1, 8]


def check(found, rows, plain, longest=1024, end_id=0):
    """Pieces of each document join to its ids; sequences are numbered without gaps, bucket after bucket."""
    assert sorted(r.sequence_id for r in found) == list(range(len(found)))
    assert all(r.offset == 0 and r.length == len(r.ids) for r in found)
    in_order = [r.length for r in sorted(found, key=lambda r: r.sequence_id)]
    assert in_order == sorted(in_order, reverse=True)
    expected = sorted((repr(k), *binary_piece) for k, t in rows for binary_piece in pieces_by_hand(plain, t, longest, end_id))
    assert sorted((repr(r.doc_id), r.start, list(r.ids), r.doc_tokens) for r in found) == expected


def pieces_by_hand(plain, text, longest, end_id):
    ids = [*plain.encode(text or "", add_special_tokens=False).ids, end_id]
    at, left = 0, len(ids)
    while left:
        size = min(longest, 1 << (left.bit_length() - 1))
        yield at, ids[at : at + size], len(ids)
        at, left = at + size, left - size


@pytest.mark.parametrize("cell_rows", [4_000, 7])
def test_odd_rows(spark, plain, monkeypatch, cell_rows):
    monkeypatch.setattr(packing, "CELL_ROWS", cell_rows)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, None), (3, None), (None, "b c"), (None, "b c"), (None, None), (77, "long text " * 9000)]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, ids string, length int").repartition(3)
    check(pack_documents(docs, BytePairs.load(PATH)).collect(), rows, plain)
    check(pack_documents(docs, BytePairs.load(PATH), longest=16, end_id=5).collect(), rows, plain, 16, 5)
    empty = pack_documents(docs.where("false"), BytePairs.load(PATH))
    assert empty.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"] and empty.count() == 0


def test_bad_arguments(spark):
    docs = spark.createDataFrame([(1, "a")], "start long, text string")
    with pytest.raises(ValueError):
        pack_documents(docs, BytePairs.load(PATH), id_col="start")
    with pytest.raises(ValueError):
        pack_documents(docs.withColumnRenamed("start", "doc_id"), BytePairs.load(PATH), longest=1000)


def test_numbers_do_not_depend_on_the_files(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    columns = ["doc_id", "start", "sequence_id"]
    one, many = (pack_documents(d, BytePairs.load(PATH)).select(columns).collect() for d in (docs.coalesce(1), docs.repartition(7)))
    assert sorted(one) == sorted(many)


def test_query(spark, plain):
    directory = "/root/testdata/sf0.001"
    found = op13_power_of_two_packing(spark, directory).collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{directory}/documents.parquet").collect()]
    expected = [
        (k, at, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)), n)
        for k, t in rows
        for at, ids, n in pieces_by_hand(plain, t, 1024, 0)
    ]
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found) == sorted(expected)
    assert sorted(r.sequence_id for r in found) == list(range(len(found))) and {r.offset for r in found} == {0}
