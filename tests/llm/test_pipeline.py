"""The pipeline: its stages by brute force on a small table, edge cases, the whole run."""

from __future__ import annotations

import hashlib
import random

import pyarrow.parquet as pq
import pytest
from test_dedup import lines_by_hand, roots_by_hand, simhash_by_hand

import corpus_pipeline
from campaignlens.llm import QUERIES
from campaignlens.llm.mixing_queries import BLOCK_DOCS, REST_WEIGHT, SEED, TARGET_WEIGHTS
from campaignlens.llm.pieces import PieceModel
from campaignlens.llm.quality import fit_quality, fold

DIRECTORY = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, mix_slot int"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    words = [f"word{i}" for i in range(200)]
    shared = " ".join(words[:12])
    out = [(None, None, None, None, None, None, None), (1, None, "en", "src1", None, "x", 1), (2, "", None, None, 0, "x", 1), (2, "", None, None, 0, "x", 1)]
    for i in range(3, 60):
        text = " ".join(rng.choice(words) for _ in range(60)) + (f"\n{shared}" if i % 3 else "")
        out.append((i, text, "en", f"src{i % 5}", len(text), "x", 1))
        if i % 7 == 0:
            out.append((i + 100, text, "en", "src0", len(text), "x", 1))
    out.append((500, "long " * 40_000, "en", "src0", 200_000, "x", 1))
    return out


def test_line_stage(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    found = STAGES["line dedup"](spark, docs, DIRECTORY)
    assert found.columns == docs.columns and found.dtypes == docs.dtypes
    texts = sorted(((r.doc_id, r.text) for r in found.collect()), key=repr)
    assert texts == sorted(((k, t) for k, t, *_ in lines_by_hand([(r[0], r[1]) for r in rows], 40, 5)), key=repr)
    assert all(r.n_chars == len(r.text) for r in found.collect())


def test_near_stage(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    found = STAGES["SimHash near-dedup"](spark, docs, DIRECTORY)
    assert found.columns == docs.columns
    prints = [simhash_by_hand(r[1]) for r in rows]
    root = roots_by_hand(sorted(set(prints)), 2)
    first = {}
    for r, p in zip(rows, prints, strict=True):
        if r[0] is not None:
            first[root[p]] = min(r[0], first.get(root[p], r[0]))
    kept = found.collect()
    assert len(kept) == len(set(root.values())) < len(rows) and {r.doc_id for r in kept} == set(first.values())
    assert {tuple(r) for r in kept} <= set(rows)


def schedule_by_hand(blocks, weights):
    """Slot by slot: the source that each slot goes to."""
    left, done, start, order = list(blocks), [0] * len(weights), 0, []
    while any(left):
        total = sum(w for w, n in zip(weights, left, strict=True) if n)
        t = len(order) - start
        ready = [(-((-(d + 1) * total) // w), i) for i, (w, d, n) in enumerate(zip(weights, done, left, strict=True)) if n and d * total // w <= t]
        i = min(ready)[1]
        order.append(i)
        left[i], done[i] = left[i] - 1, done[i] + 1
        if not left[i]:
            done, start = [0] * len(weights), len(order)
    return order


def test_mixing_stage(spark, rows, tmp_path):
    docs = spark.createDataFrame(rows, SCHEMA)
    found = STAGES["source mixing"](spark, docs, DIRECTORY)
    assert found.columns == docs.columns
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(rows, key=repr)

    # Without repeated or missing ids the order is settled to the row.
    named = [r for r in rows if r[0] not in (None, 2)]
    STAGES["source mixing"](spark, spark.createDataFrame(named, SCHEMA), DIRECTORY).coalesce(1).write.parquet(str(tmp_path / "mix"))
    read = [r.doc_id for r in spark.read.parquet(str(tmp_path / "mix")).collect()]
    names, weights = list(TARGET_WEIGHTS), [*TARGET_WEIGHTS.values(), REST_WEIGHT]
    pools = [[] for _ in weights]
    for r in named:
        pools[names.index(r[3]) if r[3] in names else -1].append((hashlib.md5(f"{SEED}:{r[0]}".encode()).hexdigest(), r[0]))
    for pool in pools:
        pool.sort()
    expected, taken = [], [0] * len(pools)
    for i in schedule_by_hand([-(-len(p) // BLOCK_DOCS) for p in pools], weights):
        expected += [k for _, k in pools[i][taken[i] * BLOCK_DOCS : (taken[i] + 1) * BLOCK_DOCS]]
        taken[i] += 1
    assert read == expected


def test_shares_stay_within_a_block(spark):
    from campaignlens.llm.mixing import mix_sources

    sources = {"a": (500, 5), "b": (40, 3), None: (300, 2), "c": (9, 1)}
    docs = spark.createDataFrame([(i, s) for s, (n, _) in sources.items() for i in range(n)], "doc_id long, source string")
    mixed = mix_sources(docs, {"a": 5, "b": 3, "c": 1}, rest_weight=2, block_docs=4)
    blocks = sorted({(r.mix_slot, r.mix_phase, r.source, r.mix_release, r.mix_deadline, r.mix_block) for r in mixed.collect()}, key=lambda b: b[0])
    assert [b[0] for b in blocks] == list(range(sum(-(-n // 4) for n, _ in sources.values())))
    left = {s: -(-n // 4) for s, (n, _) in sources.items()}
    for phase in sorted({b[1] for b in blocks}):
        alive = {s: sources[s][1] for s, n in left.items() if n}
        given = dict.fromkeys(alive, 0)
        for t, (slot, _, s, release, deadline, _) in enumerate((b for b in blocks if b[1] == phase), 1):
            given[s] += 1
            left[s] -= 1
            assert release <= slot < deadline
            assert all(abs(given[x] - t * w / sum(alive.values())) < 1 for x, w in alive.items())
    assert not any(left.values())


def test_quality_and_token_stages_on_odd_rows(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = STAGES["quality classifier"](spark, docs, DIRECTORY)
    assert kept.columns == docs.columns and kept.count() <= len(rows)
    tokens = STAGES["SentencePiece"](spark, docs, DIRECTORY).collect()
    assert len(tokens) == len(rows) and all(r.round_trip for r in tokens)
    assert sorted(r.n_tokens for r in tokens)[:4] == [0, 0, 0, 0]


def test_empty_documents(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DIRECTORY).count() == 0


def test_run_against_brute_force(spark):
    """All stages on the smallest tables; only the trained scores are taken as they are."""
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, DIRECTORY).collect()}
    docs = spark.read.parquet(f"{DIRECTORY}/documents.parquet")
    net = fit_quality(docs, spark.read.parquet(f"{DIRECTORY}/labels.parquet"), learn=fold("doc_id", 5) != 0)
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    scores = net.scores([t.encode() for _, t in rows])
    rows = [r for r, s in zip(rows, scores, strict=True) if s >= 0.3]
    rows = [(k, t) for k, t, *_ in lines_by_hand(rows, 40, 5)]
    prints = {k: simhash_by_hand(t) for k, t in rows}
    root = roots_by_hand(sorted(set(prints.values())), 2)
    first = {}
    for k, p in prints.items():
        first[root[p]] = min(k, first.get(root[p], k))
    expected = {k: t for k, t in rows if k in set(first.values())}
    assert set(found) == set(expected)
    model = PieceModel.load("/opt/tokenizers/piece_bpe_32k.model")
    for k, t in expected.items():
        assert found[k].ids == model.encode([t])[0].tolist() and found[k].round_trip
    assert "pipeline" not in QUERIES and [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier"


def test_final_files_are_in_the_order_of_the_mix(spark, tmp_path):
    """Many files of unequal size, which readers pack anew: each row is at its place of the mix."""
    rng = random.Random(4)
    docs = [(i, "word " * rng.choice([1, 5, 400]), "en", rng.choice(["src0"] * 6 + ["src1", "src4", None]), 1, "x", 1) for i in range(900)]
    spark.createDataFrame(docs, SCHEMA).repartition(12).write.parquet(str(tmp_path / "docs"))
    held = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for c, v in zip(held, ("12", "false", "3000", "100"), strict=True):
            spark.conf.set(c, v)
        table = spark.read.parquet(str(tmp_path / "docs"))
        for name in ("source mixing", "SentencePiece"):
            STAGES[name](spark, table, DIRECTORY).write.parquet(str(tmp_path / name))
            table = spark.read.parquet(str(tmp_path / name))
    finally:
        for c, v in held.items():
            spark.conf.set(c, v)

    def in_files(name):
        files = sorted((tmp_path / name).glob("part-*.parquet"))
        assert len(files) >= 10
        return [i for f in files for i in pq.read_table(f, columns=["doc_id"]).column(0).to_pylist()]

    ids = in_files("SentencePiece")
    assert ids == in_files("source mixing") and sorted(ids) == list(range(900))
    assert [r.doc_id for r in table.orderBy("mix_slot", "mix_place").collect()] == ids
