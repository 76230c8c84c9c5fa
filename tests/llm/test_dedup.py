"""Line dedup, exact dedup and SimHash near-dedup: brute force, edge cases, the queries beside their SQL."""

from __future__ import annotations

import glob
import hashlib
import os
import random

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from campaignlens.llm import QUERIES, dedup_queries  # noqa: F401
from campaignlens.llm.components import components
from campaignlens.llm.lines import dedup_lines
from campaignlens.llm.owners import exact_groups
from campaignlens.llm.simhash import fingerprint, keep_one, near_groups, near_links

SCHEMA = "doc_id long, text string, source string, n_lines string, fingerprint string"
LINE = "This line is long enough to be a candidate for removal"
ODD = [
    (1, None, None, "x", "y"),
    (2, "", "a", None, None),
    (2, "", "a", None, None),
    (None, "no id", "a", "x", None),
    (None, None, None, None, None),
    (3, " \t\n\x0b\f\r", "b", "x", None),
    (4, "é" * 50 + "\n" + LINE, None, "x", None),
    (5, ("word " * 30_000) + "\n" + LINE, "c", "x", None),
    (6, LINE + "  \n" + LINE.upper() + "\n\n", "c", "x", None),
    (7, LINE + "\nfin", "c", "x", None),
    (8, "\n" + LINE, "c", "x", None),
    (8, "\n" + LINE, "c", "x", None),
    (8, LINE + "\nother", "c", "x", None),
    (9, "a b c d", "c", "x", None),
]


def lines_by_hand(rows, min_chars, min_docs):
    blanks = " \t\n\x0b\f\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    holders = {}
    for key, text, *_ in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(line.strip(blanks).translate(lower), set()).add(key)
    out = []
    for key, text, *_ in rows:
        lines, kept = (text or "").split("\n"), []
        for line in lines:
            k = line.strip(blanks).translate(lower)
            ids = holders[k]
            gone = len(k) >= min_chars and len(ids) >= min_docs and key != max(i for i in ids if i is not None)
            kept += [] if gone else [line]
        out.append((key, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_docs", [2, 5])
def test_lines_against_brute_force(spark, min_docs):
    df = dedup_lines(spark.createDataFrame(ODD, SCHEMA), min_docs=min_docs)
    assert df.columns == ["doc_id", "text", "source", "n_lines", "fingerprint", "n_lines_", "n_dropped"]
    found = sorted(((r[0], r[1], r[5], r[6]) for r in df.collect()), key=repr)
    assert found == lines_by_hand(ODD, 40, min_docs)
    assert sum(r[3] for r in found) > 0


def test_exact_groups_against_brute_force(spark):
    rows = ODD + [(20, "same text", None, None, None), (18, "s a m e\ttext", None, None, None), (17, "sametext", None, None, None), (18, "s a m e\ttext", None, None, None)]
    for budget in (1 << 20, 600):
        found = exact_groups(spark.createDataFrame(rows, SCHEMA).repartition(3), budget=budget).collect()
        groups = {}
        for key, text, *_ in rows:
            bare = "".join(c for c in text or "" if c not in " \t\n\x0b\f\r")
            groups.setdefault(bare, []).append((-len(text or ""), key is None, key))
        expected, stays = [], 0
        for bare, members in groups.items():
            best = min(members)
            digest = hashlib.sha256(bare.encode()).hexdigest()
            expected += [(m[2], best[2], len(members), digest) for m in members]
            stays += 1
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=repr) == sorted(expected, key=repr)
        assert sum(r.kept for r in found) == stays and all(r.doc_id == r.keep_id for r in found if r.kept)


def simhash_by_hand(text, words=3):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "").translate(lower)) if w]
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def roots_by_hand(nodes, bits):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and (a ^ b).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


@pytest.mark.parametrize("text", ["", None, "one", "Two WORDS ÀB", "a b c d " * 9, "x\x0by z\x1cq w e r t y"])
def test_fingerprint_by_hand(text):
    assert fingerprint(text) == simhash_by_hand(text)


def test_spark_hash_is_the_same(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("añ b c"))).first()[0] == signed(xxhash.xxh64_intdigest("añ b c".encode(), 42))


@pytest.mark.parametrize("bits,bucket", [(2, 64), (2, 2), (1, 64), (1, 2)])
def test_links_connect_what_is_near(spark, bits, bucket):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(6)] + [0, (1 << 64) - 1, 1 << 63]
    nodes = set(base)
    for b in base:
        for _ in range(25):
            nodes.add(b ^ sum(1 << i for i in rng.sample(range(64), rng.choice([1, 1, 2, 2, 3]))))
    nodes = sorted(signed(n) for n in nodes)
    links = near_links(spark.createDataFrame([(n,) for n in nodes], "node long"), bits, bucket)
    assert all(((r.u ^ r.v) & ((1 << 64) - 1)).bit_count() <= bits for r in links.collect())
    found = {r.node: r.root for r in components(links).collect()}
    unsigned = roots_by_hand([n & ((1 << 64) - 1) for n in nodes], bits)
    groups = {}
    for n, r in unsigned.items():
        groups.setdefault(r, set()).add(signed(n))
    for members in groups.values():
        assert {found.get(m, m) for m in members} == {min(members)}


def test_components_of_a_long_chain(spark):
    chain = spark.range(500).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    rows = components(chain.union(spark.createDataFrame([(7, 7), (900, 901)], "u long, v long"))).collect()
    assert {r.node: r.root for r in rows} == {**{i: 0 for i in range(501)}, 900: 900, 901: 900}
    assert components(chain.where("false")).count() == 0


def copies():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for d in range(60):
        text = [rng.choice(words) for _ in range(150)]
        rows.append((d, " ".join(text)))
        for k in range(d % 4):
            changed = list(text)
            changed[rng.randrange(150)] = "changed"
            rows.append((1000 + 10 * d + k, " ".join(changed)))
    return [(k, t, None, None, None) for k, t in rows] + ODD


def test_near_groups_against_brute_force(spark):
    rows = copies()
    found = near_groups(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    prints = [simhash_by_hand(t) for _, t, *_ in rows]
    root = roots_by_hand(sorted(set(prints)), 2)
    first = {}
    for (key, *_), p in zip(rows, prints, strict=True):
        if key is not None:
            first[root[p]] = min(key, first.get(root[p], key))
    expected = sorted(((k, signed(p), first.get(root[p])) for (k, *_), p in zip(rows, prints, strict=True)), key=repr)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in found), key=repr) == expected
    assert len(set(root.values())) < len(set(prints)) < len(rows)
    kept = keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(kept) == len(set(root.values()))
    assert {r.doc_id for r in kept if r.doc_id is not None} == set(first.values())


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert [f(empty).count() for f in (dedup_lines, exact_groups, near_groups, keep_one)] == [0, 0, 0, 0]


@pytest.mark.parametrize("name", ["op8_exact_dedup", "op9_line_dedup"])
def test_query_agrees_with_sql(spark, name):
    from campaignlens.llm import ORACLES

    directory, db = "/root/testdata/sf0.001", duckdb.connect()
    for path in glob.glob(f"{directory}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    df, sql = QUERIES[name](spark, directory), db.sql(ORACLES[name])
    names = sorted(df.columns)
    assert names == sorted(sql.columns)
    assert sorted(repr(tuple(r[c] for c in names)) for r in df.collect()) == sorted(map(repr, sql.select(*names).fetchall()))


def test_simhash_query_against_brute_force(spark):
    directory = "/root/testdata/sf0.001"
    found = QUERIES["op10_simhash_near_dedup"](spark, directory).collect()
    rows = spark.read.parquet(f"{directory}/documents.parquet").select("doc_id", "text").collect()
    prints = {r.doc_id: simhash_by_hand(r.text) for r in rows}
    root = roots_by_hand(sorted(set(prints.values())), 2)
    first = {}
    for key, p in prints.items():
        first[root[p]] = min(key, first.get(root[p], key))
    assert sorted(map(tuple, found)) == sorted((k, f"{p:016x}", first[root[p]]) for k, p in prints.items())
