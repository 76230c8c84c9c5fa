"""Token alignment: groups, links and counts against whole texts in plain Python; the perfect hash."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from campaignlens.llm import alignment
from campaignlens.llm.alignment import Aligner, Pieces, align_tokens, aligned_rows
from campaignlens.llm.alignment_queries import op11_token_alignment
from campaignlens.llm.byte_pairs import WINDOW, BytePairs
from campaignlens.llm.perfect_hash import PerfectHash, build

A, B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
ODD = [
    "a", " ", "  ", "  a", " a", "a  b ", "a\n\nb\tc d", "don't 12 3%", "日本語 テスト", "😀 x", "▁", "a ▁b c", "x" * 700, "\x00 a", "é ﬁ Ａ",
    "<|endoftext|> <s> </s> <0x41> <unk>", "tokenization internationalisation", " \x1c a", "a  b", "for (i = 0; i < n; i++) {\r\n    x();\r\n}",
]


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    names = a.get_vocab()
    chars = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in chars]
    byte_of = {chr(b): b for b in chars} | {chr(256 + i): b for i, b in enumerate(rest)}
    a_bytes = {i: bytes(byte_of[c] for c in t) for t, i in names.items() if i != 50256}
    return a, a_bytes, sentencepiece.SentencePieceProcessor(model_file=B)


def align_by_hand(plain, text):
    """Groups as pairs of id lists, and all links, by walking the bytes of the whole text."""
    a, a_bytes, b = plain
    if not text:
        return [], []
    data = f" {text}".encode()
    ids_a, ids_b = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
    bytes_a = [a_bytes[i] for i in ids_a]
    if b"".join(bytes_a) != data or b"".join(bytes_b) != data:
        return [], []
    owner_a, owner_b = ([n for n, part in enumerate(x) for _ in part] for x in (bytes_a, bytes_b))
    seen = dict.fromkeys(zip(owner_a, owner_b, strict=True))
    ends = [set(np.cumsum([len(p) for p in x]).tolist()) for x in (bytes_a, bytes_b)]
    groups, at = [([], [])], 0
    spans = sorted([(e, 0, i) for e, i in zip(np.cumsum([len(p) for p in bytes_a]).tolist(), ids_a, strict=True)] + [(e, 1, i) for e, i in zip(np.cumsum([len(p) for p in bytes_b]).tolist(), ids_b, strict=True)], key=lambda s: (s[0], s[1]))
    for end, side, i in spans:
        if at in ends[0] and at in ends[1] and at < end and (groups[-1][0] and groups[-1][1]):
            groups.append(([], []))
        groups[-1][side].append(i)
        at = end
    return groups, [(ids_a[x], ids_b[y]) for x, y in seen]


def written_by_hand(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def rows_by_hand(plain, texts):
    aligned = [align_by_hand(plain, t) for t in texts]
    counts = Counter(pair for _, links in aligned for pair in set(links))
    best = Counter()
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    return [
        (
            sum(len(a) for a, _ in groups),
            sum(len(b) for _, b in groups),
            len(groups),
            len(links),
            sum(counts[x] == best[x[0]] for x in links),
            sum(counts[x] for x in links),
            written_by_hand(groups),
        )
        for groups, links in aligned
    ]


def test_perfect_hash():
    rng = np.random.default_rng(4)
    for size in (1, 2, 3, 64, 1000, 70_000):
        keys = rng.choice(1 << 40, size, replace=False) if size < 1000 else np.arange(size) * 32_000
        levels, order = build(keys)
        one = PerfectHash.of([(levels, order)])
        assert sorted(one.find(keys).tolist()) == list(range(size)) and (order[one.find(keys)] == keys).all()
        assert (one.find(keys + (1 << 41)) == -1).all()
        shards = [build(keys[keys % 5 == i]) for i in range(5)]
        several = PerfectHash.of([s if len(s[1]) else ([np.zeros(0, bool)], np.zeros(0, np.int64)) for s in shards])
        at = several.find(keys, keys % 5)
        assert sorted(at.tolist()) == list(range(size)) and (several.keys[at] == keys).all()
    nothing = PerfectHash.of([([np.zeros(0, bool)], np.zeros(0, np.int64))])
    assert nothing.find(np.array([1, 2])).tolist() == [-1, -1]


def test_words_give_the_alignment_of_whole_texts(plain):
    rng = random.Random(2)
    letters = "the quick's  \n\t é日!▁{}\r\x00"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    aligner = Aligner(BytePairs.load(A, plain=True), Pieces.load(B))
    for _ in range(2):
        found = {i: r for i, *r in aligned_rows(aligner, texts)}
        for i, text in enumerate(texts):
            groups, links = align_by_hand(plain, text)
            assert (i in found) == bool(groups), text
            if groups:
                n_a, n_b, n_groups, keys, times, written = found[i]
                assert written == written_by_hand(groups), text
                assert (n_a, n_b, n_groups) == (sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups))
                assert dict(zip(keys.tolist(), times.tolist(), strict=True)) == Counter(a * aligner.width + b for a, b in links)


def test_long_texts_are_read_in_windows(plain):
    text = "word and  more, " * (WINDOW // 12)
    aligner = Aligner(BytePairs.load(A, plain=True), Pieces.load(B))
    bad = text + "▁"
    ((i, *found),) = aligned_rows(aligner, [None, text, bad, ""])
    groups, links = align_by_hand(plain, text)
    assert i == 1 and found[5] == written_by_hand(groups) and found[2] == len(groups) and found[4].sum() == len(links)


@pytest.mark.parametrize("bound", [alignment.MAX_SHIPPED, 40, 0])
def test_tables(spark, plain, monkeypatch, bound):
    monkeypatch.setattr(alignment, "SHARD_KEYS", 50)
    monkeypatch.setattr(alignment, "FAN", 2)
    rng = random.Random(6)
    texts = [*ODD, None, "", "a  b ", *(" ".join(rng.choices(["token", "ization", "né", "x1", "the", "(y)"], k=rng.randint(1, 20))) for _ in range(80))]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "n_a long, text string, late_best int, groups string").repartition(7)
    found = align_tokens(docs, BytePairs.load(A, plain=True), Pieces.load(B), max_shipped=bound)
    new = ["n_a_", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_"]
    assert found.columns == ["n_a", "late_best", "groups", *new]
    own = sorted((r.n_a, *(r[c] for c in new)) for r in found.collect())
    assert own == [(i, *r) for i, r in enumerate(rows_by_hand(plain, texts))]


def test_empty_and_pairless_tables(spark):
    docs = spark.createDataFrame([(1, None), (1, ""), (None, "▁")], "doc_id long, text string")
    a, b = BytePairs.load(A, plain=True), Pieces.load(B)
    assert [tuple(r)[1:] for r in align_tokens(docs, a, b).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 3
    assert align_tokens(docs.where("false"), a, b).count() == 0


def test_query(spark, plain):
    directory = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{directory}/documents.parquet").orderBy("doc_id").collect()
    found = sorted(map(tuple, op11_token_alignment(spark, directory).collect()))
    expected = rows_by_hand(plain, [r.text for r in rows])
    assert found == [(r.doc_id, *x[:6], hashlib.sha256(x[6].encode()).hexdigest() if x[6] else "") for r, x in zip(rows, expected, strict=True)]
