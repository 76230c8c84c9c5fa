"""Importance resampling towards a target distribution.

Every text is an array of hashed features: all runs of one to three words. Two arrays of
bucket counts, of the documents and of the target texts, give each bucket its gain; a
document's weight is the sum of the gains over its feature array. Adding Gumbel noise
turns the draw without replacement into the rows with the highest scores. The cutoff is
found by bisecting numbers, first the score, then the id among rows that tie: each step
is one exact count over the written scores. Only the rows drawn are sorted, in ranges.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from campaignlens.llm.texts import free_name
from campaignlens.operators.sizing import shuffle_width
from campaignlens.session import written

# Lower case for A-Z; every other ASCII byte that is no digit or letter becomes a blank.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
WINDOW = 1 << 20  # bytes of a text worked at a time
HALVINGS = 4  # steps of the bisection that one count job settles
LARGEST = (1 << 63) - 1


def windows(data: bytes, size: int = WINDOW) -> Iterator[bytes]:
    """The normalised text in parts of about ``size`` bytes that end at a blank; a longer word stays whole."""
    data = data.translate(_WORDS)
    start = 0
    while len(data) - start > size:
        cut = data.find(b" ", start + size)
        if cut < 0:
            break
        yield data[start:cut]
        start = cut + 1
    yield data[start:]


def features(data: bytes | None, buckets: int, longest: int = 3) -> Iterator[tuple[int, np.ndarray]]:
    """Per window of a text, the number of its words and the buckets of the word runs that end in it, repeats included."""
    before: list[list[int]] = [[] for _ in range(longest - 1)]
    for window in windows(data or b""):
        words = window.split()
        if not words:
            continue
        # crc32 goes on from the checksum of the run without its last word. ``ends[k]`` are
        # the checksums of the runs of k + 1 words that end in the window, in order.
        follow = [b" " + w for w in words]
        ends = [list(map(crc32, words))]
        for k in range(1, longest):
            runs = (before[k - 1] + ends[k - 1])[:-1]
            ends.append(list(map(crc32, follow[len(words) - len(runs) :], runs)))
        hashes = [h for part in ends for h in part]
        yield len(words), np.array(hashes, np.uint32) % np.uint32(buckets)
        before = [part[-1:] for part in ends[: longest - 1]]


def bucket_counts(texts: DataFrame, buckets: int, longest: int = 3, text_col: str = "text") -> np.ndarray:
    """How many features of all the table's whole texts fall into each bucket.

    A task counts into one array; the driver sees one sum per bucket.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for _, found in features(text.as_py(), buckets, longest):
                    counts += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(counts[held])], names=["bucket", "n"])

    partial = texts.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for row in partial.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of the target's smoothed share to the documents') per bucket."""
    size, all_docs, all_target = len(documents), float(documents.sum()), float(target.sum())
    ratio = (target + 1.0) * (all_docs + size) / ((documents + 1.0) * (all_target + size))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio.tolist()], np.int64)


def gumbel(id_col: str, seed: int) -> Column:
    """floor(1000 g), g the Gumbel draw of the first 32 bits of sha256(seed:id)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    return F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0)))


def score_documents(
    docs: DataFrame, gain: np.ndarray, longest: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The table without its text and with ``n_words``, ``n_features``, ``weight`` and ``score``."""
    rest = [c for c in docs.columns if c != text_col]
    names = [free_name(docs, c) for c in ("n_words", "n_features", "weight")]
    schema = docs.select(*rest).schema
    for name in names:
        schema = schema.add(name, "long", False)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.zeros((3, batch.num_rows), np.int64)
            for i, text in enumerate(batch.column(batch.num_columns - 1)):
                for words, found in features(text.as_py(), len(gain), longest):
                    sums[:, i] += words, len(found), gain[found].sum()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, sums)], names=schema.names)

    scored = docs.select(*rest, F.col(text_col).cast("binary").alias(text_col)).mapInArrow(run, schema)
    return scored.withColumn(free_name(docs, "score"), F.col(names[2]) + gumbel(id_col, seed))


def smallest(table: DataFrame, value: str, wanted: int, low: int, high: int) -> int:
    """The smallest number v from ``low`` to ``high`` such that at least ``wanted`` rows have ``value`` <= v; ``high`` if none has.

    By bisection: every job counts the rows up to each of the marks that the next few halvings can ask for.
    """
    while low < high:
        parts = 1 << HALVINGS
        marks = sorted({low + (high - low + 1) * i // parts - 1 for i in range(1, parts)} - {low - 1})
        row = table.agg(*[F.count_if(F.col(value) <= F.lit(m)).alias(f"n{i}") for i, m in enumerate(marks)]).first()
        enough = [m for m, n in zip(marks, row, strict=True) if n >= wanted]
        short = [m for m, n in zip(marks, row, strict=True) if n < wanted]
        if enough:
            high = enough[0]
        if short:
            low = short[-1] + 1
    return high


def cutoff(scores: DataFrame, wanted: int) -> Column:
    """The condition that the ``wanted`` first rows meet, in the order of score (highest first), id and place.

    Reads columns ``score``, ``id_key`` and ``place`` (longs, the last one unique). The
    score that the last row drawn has is bisected, then the id among rows of that score,
    then the place among rows of that score and id.
    """
    met = F.lit(False)
    tied, order = scores.withColumn("fall", -F.col("score")), F.lit(True)
    for column in ("fall", "id_key", "place"):
        row = tied.agg(F.min(column), F.max(column)).first()
        mark = smallest(tied, column, wanted, row[0], row[1])
        value = -F.col("score") if column == "fall" else F.col(column)
        met = met | (order & (value < F.lit(mark)))
        order = order & (value == F.lit(mark))
        at, below = tied.agg(F.count_if(F.col(column) == F.lit(mark)), F.count_if(F.col(column) < F.lit(mark))).first()
        wanted -= below
        if at == wanted:
            break
        tied = tied.where(F.col(column) == F.lit(mark))
    return met | order


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 5,
    min_words: int = 20,
    buckets: int = 10_000,
    longest: int = 3,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
) -> DataFrame:
    """Every row without its text, with ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank``.

    Of the N rows with at least ``min_words`` words, the floor(N * percent / 100) with the
    highest scores are drawn; ``rank`` counts them from 1 by falling score, then rising id
    (which must be a whole number), and is null for all others. A name the table has gets
    underscores.

    Null and empty texts have no features and weight 0. Rows that repeat an id share its
    noise; among rows with equal score and id the order is that of the files they were
    written to. Rows without an id share one draw of noise and come after all ids of their
    score. Without target texts, or without documents, gains follow from empty counts; an
    empty table gives an empty table. Texts of any length are read whole, in windows.
    """
    gain = gains(bucket_counts(docs, buckets, longest, text_col), bucket_counts(target, buckets, longest, target_text_col))
    n_words, n_features, weight, score, rank = (free_name(docs, c) for c in ("n_words", "n_features", "weight", "score", "rank"))
    rest = [c for c in docs.columns if c != text_col]
    scored = score_documents(docs, gain, longest, seed, id_col, text_col)
    names = dict(zip(scored.columns, [f"c{i}" for i in range(len(scored.columns))], strict=True))
    key = F.coalesce(F.col(names[id_col]).cast("long"), F.lit(LARGEST))
    table = written(
        scored.withColumnsRenamed(names)
        .withColumn("score", F.col(names[score]))
        .withColumn("id_key", key)
        .withColumn("place", F.monotonically_increasing_id()),
        "scores",
    )
    eligible = F.col(names[n_words]) >= min_words
    wanted = table.where(eligible).count() * percent // 100
    columns = [*rest, n_words, n_features, weight, score]
    drawn = eligible & cutoff(table.where(eligible).select("score", "id_key", "place"), wanted) if wanted else F.lit(False)
    plain = [F.col(names[c]).alias(c) for c in columns]
    order = [F.desc("score"), F.asc("id_key"), F.asc("place")]

    # Ranges of the rows drawn, written with their number; a rank is counted within its range.
    ranges = written(
        table.where(drawn).repartitionByRange(shuffle_width(table), *order).withColumn("range", F.spark_partition_id()), "ranges"
    )
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    # One row per shuffle partition.
    sizes = ranges.groupBy("range").agg(F.count("*").alias("n"))
    offsets = sizes.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    ranked = ranges.join(F.broadcast(offsets), "range").select(
        *plain, (F.row_number().over(W.partitionBy("range").orderBy(*order)) + F.col("offset")).alias(rank)
    )
    others = table.where(~drawn).select(*plain, F.lit(None).cast("long").alias(rank))
    return ranked.union(others)

