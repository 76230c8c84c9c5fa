"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces of the lengths that the binary digits of n name:
as many of the greatest length as fit, then each smaller power of two at most once. Every
piece is a sequence, so no sequence crosses documents and none is padded. Pieces of equal
length form a bucket; a batch is drawn from one bucket.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from campaignlens.llm.byte_pairs import BytePairs
from campaignlens.llm.texts import slices
from campaignlens.session import written

# Pieces of a hash cell that are numbered in one task.
CELL_ROWS = 4_000


def binary_lengths(sizes: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The piece lengths of documents of these sizes, longest first, and the number of pieces of each document."""
    powers = 1 << np.arange(longest.bit_length() - 1, -1, -1)
    times = sizes[:, None] // powers % 2
    times[:, 0] = sizes // longest
    return np.repeat(np.tile(powers, len(sizes)), times.ravel()), times.sum(axis=1)


def cut_documents(
    docs: DataFrame, tokenizer: BytePairs, longest: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The pieces of every whole text: id, ``start``, ``length``, ``ids``, ``doc_tokens`` and ``copy``.

    ``end_id`` closes each document, so a null or empty text is one piece of one token.
    ``copy`` numbers the rows of a task that share an id.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the greatest length must be a power of two")
    names = ["start", "length", "ids", "doc_tokens", "copy"]
    types = [T.LongType(), T.LongType(), T.ArrayType(T.IntegerType(), False), T.LongType(), T.LongType()]
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType)])
    for name, kind in zip(names, types, strict=True):
        schema = schema.add(name, kind, False)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter()
        for batch in slices(batches, "text"):
            keys = batch.column("id").to_pylist()
            flat, offsets = tokenizer.encode([t or "" for t in batch.column("text").to_pylist()])
            flat = np.insert(flat, offsets[1:], end_id)
            sizes = np.diff(offsets) + 1
            lengths, pieces = binary_lengths(sizes, longest)
            ends = np.cumsum(lengths)
            owner = np.repeat(np.arange(len(keys)), pieces)
            copies = np.empty(len(keys), np.int64)
            for i, key in enumerate(keys):
                copies[i] = seen[key]
                seen[key] += 1
            columns = [
                batch.column("id").take(pa.array(owner)),
                pa.array(ends - lengths - (np.cumsum(sizes) - sizes)[owner]),
                pa.array(lengths),
                pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(flat, pa.int32())),
                pa.array(sizes[owner]),
                pa.array(copies[owner]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", *names])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def pack_documents(
    docs: DataFrame,
    tokenizer: BytePairs,
    longest: int = 1024,
    end_id: int = 0,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Every document as sequences of power-of-two length: id, ``start``, ``length``, ``ids``, ``doc_tokens``, ``sequence_id``, ``offset``.

    A document's tokens are its ids and ``end_id``; ``start`` counts those before the
    piece. Sequences are numbered from 0 without gaps, bucket after bucket from the
    longest, within a bucket in the order of a hash of seed, id and start; each holds one
    piece, at offset 0, and needs no padding.

    Null and empty texts are one sequence of ``end_id`` alone. Rows that repeat an id, or
    have none, are documents of their own; which of them comes first in a bucket depends on
    the files they are read from. Texts of any length are read whole, in windows. An empty
    table gives an empty table. Columns other than id and text are not read, so their names
    cannot clash; the id column keeps its name and type, and must not be called like one of
    the new columns.
    """
    if id_col.lower() in {"start", "length", "ids", "doc_tokens", "sequence_id", "offset"}:
        raise ValueError(f"rename the id column {id_col}: the result has a column of that name")
    pieces = written(cut_documents(docs, tokenizer, longest, end_id, id_col, text_col), "pieces")
    # At most one row per power of two.
    buckets = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    first, cells, total = {}, {}, 0
    for length in sorted(buckets, reverse=True):
        first[length], cells[length] = total, -(-buckets[length] // CELL_ROWS)
        total += buckets[length]

    def of(values: dict[int, int]):
        powers = [1 << b for b in range(longest.bit_length())]
        return F.element_at(F.create_map(*[F.lit(x).cast("long") for p in powers for x in (p, values.get(p, 0))]), F.col("length"))

    drawn = pieces.withColumn("draw", F.xxhash64(F.lit(seed), "id", "start", "copy")).withColumn(
        "cell", F.floor(F.shiftrightunsigned("draw", 33) * of(cells) / F.lit(1 << 31))
    )
    before = W.partitionBy("length").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        drawn.groupBy("length", "cell")
        .agg(F.count("*").alias("n"))
        .select("length", "cell", (of(first) + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("cell_first"))
    )
    inside = W.partitionBy("length", "cell").orderBy("draw", "id", "start", "copy", "doc_tokens")
    return drawn.join(offsets, ["length", "cell"]).select(
        F.col("id").alias(id_col),
        "start",
        "length",
        "ids",
        "doc_tokens",
        (F.col("cell_first") + F.row_number().over(inside) - 1).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
