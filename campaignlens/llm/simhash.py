"""SimHash near-dedup with deletion-variant signatures.

A fingerprint is cut into segments, one fewer than usual: with two segments and two
differing bits, one segment differs by at most one bit. Each segment is indexed once per
wildcard position (the segment with that bit blanked), so two fingerprints within reach
meet in an equality join on (segment, wildcard, remaining bits), and the join's pairs
are verified by their bit distance.

Exact copies of a fingerprint are one node. A bucket with more than MAX_BUCKET nodes is
not joined with itself: its nodes are listed under every point at most one bit away.
Nodes listed under the same point are within two bits of each other, any two nodes within
two bits share a point, and no point lists more than 65 nodes, so this finds the same
links at a cost that is linear in the nodes however dense the bucket is.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campaignlens.llm.components import components
from campaignlens.llm.texts import free_name
from campaignlens.session import written

BITS, MAX_BUCKET, SEED, STEP = 64, 64, 42, 1 << 16


def fingerprint(text: str | bytes | None, words: int = 3) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles; 0 without words."""
    data = (text or b"") if not isinstance(text, str) else text.encode()
    tokens = data.lower().split()  # of bytes: A-Z only, and the six ASCII blanks only
    if not tokens:
        return 0
    joined = memoryview(b" ".join(tokens))
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(words, len(tokens))
    starts, ends = starts[: len(tokens) - width + 1], ends[width - 1 :]
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(starts), STEP):
        hashes = [
            xxhash.xxh64_intdigest(joined[a:b], SEED)
            for a, b in zip(starts[i : i + STEP].tolist(), ends[i : i + STEP].tolist(), strict=True)
        ]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in range(BITS) if 2 * counts[b] > len(starts))


def fingerprints(docs: DataFrame, words: int = 3, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """The table without its text and with the signed 64-bit SimHash of it as ``name``."""
    rest = [c for c in docs.columns if c != text_col]
    schema = docs.select(*rest).schema.add(name, "long", False)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py(), words) for t in batch.column(batch.num_columns - 1)]
            column = pa.array(np.array(prints, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], column], names=[*rest, name])

    return docs.select(*rest, F.col(text_col).cast("binary").alias(text_col)).mapInArrow(run, schema)


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def variants(node: Column, max_bits: int) -> Column:
    """The signatures of a fingerprint: an array with one (segment, wildcard, bits left) after the other.

    Each is one number. Segments of 32 bits leave room for the wildcard; of one segment of
    64 bits it is a hash, whose rare collisions only make pairs that are then refused.
    """
    parts = max_bits // 2 + 1
    width = BITS // parts

    def signature(i: int, bit: int) -> Column:
        mask = ((1 << width) - 1) & ~(1 << bit)
        bits = F.shiftrightunsigned(node, i * width).bitwiseAND(F.lit(signed(mask)).cast("long"))
        if width == BITS:
            return F.xxhash64(F.lit(bit), bits)
        return bits.bitwiseOR(F.lit((i * width + bit) << width).cast("long"))

    return F.array(*[signature(i, bit) for i in range(parts) for bit in range(width)])


def near_links(nodes: DataFrame, max_bits: int = 2, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column ``node``) that connect all pairs within ``max_bits``.

    Every link is within reach, and any two nodes within reach are joined by a path of links.
    """
    index = nodes.select("node", F.explode(variants(F.col("node"), max_bits)).alias("signature"))
    # Most signatures have one node; those of two are a pair at once.
    buckets = written(
        index.groupBy("signature")
        .agg(F.count("*").alias("n"), F.min("node").alias("u"), F.max("node").alias("v"))
        .where("n > 1"),
        "buckets",
    )
    pairs = buckets.where("n = 2").select("u", "v")
    # The same join at every size: a table of larger buckets grows with the input.
    larger = buckets.where("n > 2").select("signature", "n").hint("merge")
    members = written(index.join(larger, "signature"), "members")
    small = members.where(F.col("n") <= max_bucket).select("signature", "node")
    joined = (
        small.withColumnRenamed("node", "u").join(small.withColumnRenamed("node", "v"), "signature").where("u < v").select("u", "v")
    )
    verified = pairs.union(joined).where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits).distinct()

    crowded = members.where(F.col("n") > max_bucket).select("node").distinct()
    flips = F.array(*[F.lit(signed(1 << b)).cast("long") for b in range(BITS)])
    flipped = crowded.select("node", F.explode(F.transform(flips, lambda f: F.col("node").bitwiseXOR(f))).alias("point"))
    if max_bits == 1:  # a node is itself a point around each of its neighbours
        dense = flipped.join(crowded.select(F.col("node").alias("point")), "point").select(F.col("node").alias("u"), F.col("point").alias("v"))
    else:  # two nodes within two bits share a point at most one bit from both
        around = flipped.union(crowded.select("node", F.col("node").alias("point")))
        lowest = around.groupBy("point").agg(F.min("node").alias("u"), F.count("*").alias("n")).where("n > 1").drop("n")
        dense = around.join(lowest, "point").where("u <> node").select("u", F.col("node").alias("v")).distinct()
    return verified.union(dense)


def near_groups(
    docs: DataFrame,
    words: int = 3,
    max_bits: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_bucket: int = MAX_BUCKET,
) -> DataFrame:
    """Per row: its id, ``text_md5``, ``fingerprint`` (signed), ``component`` (the smallest fingerprint reachable) and ``component_id``.

    Texts are lower-cased in A-Z, split at ASCII blanks and cut into ``words``-word shingles,
    repeats included; fewer words are one shingle. Fingerprints link at ``max_bits`` (0 to 2)
    or fewer differing bits; ``component_id`` is the smallest id reachable by links.

    Null and empty texts have fingerprint zero, which links like any other. Rows that repeat
    an id, a text or both are rows of the result. Rows without an id link like others; a
    component of such rows only has a null ``component_id``. An empty table gives an empty
    one. Columns other than id and text are not read, so their names cannot clash.
    """
    if max_bits not in (0, 1, 2):
        raise ValueError("max_bits must be 0, 1 or 2")
    slim = docs.select(F.col(id_col).alias("id"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("text_md5"), F.col(text_col).alias("text"))
    prints = written(fingerprints(slim, words), "fingerprints")
    nodes = written(prints.groupBy(F.col("fingerprint").alias("node")).agg(F.min("id").alias("first_id")), "nodes")
    links = near_links(nodes.select("node"), max_bits, max_bucket) if max_bits else nodes.select(F.col("node").alias("u"), F.col("node").alias("v")).where("false")
    roots = components(links)
    rooted = nodes.join(roots, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("component"))
    first = rooted.groupBy("component").agg(F.min("first_id").alias("component_id"))
    classes = rooted.join(first, "component").select(F.col("node").alias("fingerprint"), "component", "component_id")
    return prints.join(classes, "fingerprint").select(
        F.col("id").alias(id_col), "text_md5", "fingerprint", "component", "component_id"
    )


def keep_one(docs: DataFrame, words: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of the table that stay when each component keeps one row, whole and unchanged.

    The row with the smallest id stays (rows without an id come last); among rows that
    share it, the one with the smallest text md5, then the smallest of the other columns.
    Edge cases are as in :func:`near_groups`.
    """
    groups = near_groups(docs, words, max_bits, id_col, text_col)
    rank = F.struct(F.col(id_col).isNull().alias("unnamed"), F.col(id_col).alias("id"), F.col("text_md5").alias("md5"))
    chosen = groups.groupBy("component").agg(F.min(rank).alias("best")).select("best.id", "best.md5")
    kept_id, kept_md5, whole = (free_name(docs, c) for c in ("kept_id", "kept_md5", "kept_row"))
    chosen = chosen.distinct().withColumnsRenamed({"id": kept_id, "md5": kept_md5})
    text_md5 = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.join(chosen, F.col(id_col).eqNullSafe(F.col(kept_id)) & (text_md5 == F.col(kept_md5)))
    return (
        rows.groupBy(kept_id, kept_md5).agg(F.min(F.struct(*docs.columns)).alias(whole)).select(f"{whole}.*")
    )
