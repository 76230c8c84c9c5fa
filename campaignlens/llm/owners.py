"""Exact dedup by Patricia-trie owners.

Equal texts are found by comparing all their bytes in compressed radix tries. Each task
first builds tries over its own rows and writes one row per distinct text, so that a text
copied millions of times crosses the network once per task. These rows are partitioned by
length and content hash; each partition inserts them into a trie whose terminal nodes hold
the smallest owner, spilling by subtree beyond a budget. A document learns its owner
through the number of its text within its own task, not through a hash.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from campaignlens.llm.texts import BLANKS, slices
from campaignlens.llm.trie import OwnerTrie
from campaignlens.session import written

BUDGET = 64 << 20
OUT_BYTES = 4 << 20

# One kind of row per document (its task's number for its text), one per distinct text of a task.
LOCAL = T.StructType(
    [
        T.StructField("local", T.StringType()),
        T.StructField("id", T.LongType()),
        T.StructField("row", T.LongType()),
        T.StructField("points", T.LongType()),
        T.StructField("size", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("hash", T.LongType()),
        T.StructField("text", T.BinaryType()),
    ]
)
OWNED = T.StructType(
    [
        T.StructField("local", T.StringType()),
        T.StructField("keep_id", T.LongType()),
        T.StructField("keep_local", T.StringType()),
        T.StructField("keep_row", T.LongType()),
        T.StructField("group_size", T.LongType()),
        T.StructField("text_sha256", T.StringType()),
    ]
)
LAST = (1 << 63) - 1


def better(a: tuple, b: tuple) -> tuple:
    """Most code points, then the smallest id (none last), then the first row."""
    return min(a, b)


def _arrow(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[f.dataType.simpleString()]) for c, f in zip(columns, schema, strict=True)], names=schema.names
    )


def _batches(rows: Iterator[tuple], schema: T.StructType, size=lambda row: 100) -> Iterator[pa.RecordBatch]:
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total > OUT_BYTES or len(held) >= 20_000:
            yield _arrow(held, schema)
            held, total = [], 0
    if held:
        yield _arrow(held, schema)


def local_owners(budget: int):
    """Numbers the distinct texts of a task's rows; a full trie is given out and begun anew."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = uuid.uuid4().hex
        row, number, trie, held = 0, 0, OwnerTrie(lambda a, b: a, 1 << 62), {}

        def texts() -> Iterator[tuple]:
            for text, no in trie.items():
                (points, key, first), size, length, digest = held[no]
                yield (f"{task}-{no}", None if key == LAST + 1 else key, first, -points, size, length, digest, text)

        for batch in slices(batches, "text", 1 << 22):
            members = []
            columns = [batch.column(c).to_pylist() for c in ("id", "points", "length", "hash", "text")]
            for key, points, length, digest, text in zip(*columns, strict=True):
                mine = (-points, LAST + 1 if key is None else key, row)
                found: list[int] = []
                trie.merge = lambda old, _, found=found: found.append(old) or old
                trie.insert(text, number)
                if found:
                    no = found[0]
                    best, size, *rest = held[no]
                    held[no] = (better(best, mine), size + 1, *rest)
                else:
                    no, number = number, number + 1
                    held[no] = (mine, 1, length, digest)
                members.append((f"{task}-{no}", key, row, None, None, None, None, None))
                row += 1
            yield from _batches(iter(members), LOCAL)
            if trie.size > budget:
                yield from _batches(texts(), LOCAL, lambda r: 100 + len(r[-1]))
                trie, held = OwnerTrie(lambda a, b: a, 1 << 62), {}
        yield from _batches(texts(), LOCAL, lambda r: 100 + len(r[-1]))

    return run


def merge_owners(budget: int):
    """The owner and size of every distinct text of a partition, for each task that has the text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        # A value: the best row so far, the size of the group, the numbers the text has in its tasks.
        def merge(a: tuple, b: tuple) -> tuple:
            a[2].extend(b[2])
            return min(a[0], b[0]), a[1] + b[1], a[2]

        trie = OwnerTrie(merge, budget)
        try:
            for batch in slices(batches, "text", 1 << 22):
                columns = [batch.column(c).to_pylist() for c in ("local", "id", "row", "points", "size", "text")]
                for local, key, row, points, size, text in zip(*columns, strict=True):
                    best = (-points, LAST + 1 if key is None else key, local, row)
                    trie.insert(text, (best, size, [local]))

            def rows() -> Iterator[tuple]:
                for text, ((_, key, keep, row), size, locals_) in trie.items():
                    digest, kept = hashlib.sha256(text).hexdigest(), None if key == LAST + 1 else key
                    for local in locals_:
                        yield local, kept, keep, row, size, digest

            yield from _batches(rows(), OWNED, lambda r: 200)
        finally:
            trie.close()

    return run


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET
) -> DataFrame:
    """Per row of the table: id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when identical after deleting every character of ``[\\x20\\x09-\\x0D]``;
    null counts as empty. Of equal texts the row with the most code points stays, then the
    one with the smallest id (a null id last), then one of the rows that repeat that id.
    ``text_sha256`` is of the text without blanks.

    ``keep_id`` is null only where no row of the group has an id. An empty table gives an
    empty table. Texts of any length are compared whole. Only id and text are read, so
    names of other columns cannot clash. ``budget`` bounds a task's trie in bytes.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.translate(text, BLANKS, "").cast("binary")
    plain = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.char_length(text).cast("long").alias("points"),
        F.octet_length(bare).cast("long").alias("length"),
        F.xxhash64(bare).alias("hash"),
        bare.alias("text"),
    )
    local = written(plain.mapInArrow(local_owners(budget), LOCAL), "owners")
    # Full texts, dealt out by length and content hash.
    owned = (
        local.where(F.col("text").isNotNull())
        .repartition("length", "hash")
        .mapInArrow(merge_owners(budget), OWNED)
    )
    members = local.where(F.col("text").isNull()).select("local", "id", "row")
    return members.join(owned, "local").select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        ((F.col("local") == F.col("keep_local")) & (F.col("row") == F.col("keep_row"))).alias("kept"),
        "text_sha256",
    )
