"""Small helpers on texts that several operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space of the text contracts: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def fold_case(text: Column) -> Column:
    """A-Z lowered, every other character as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or it with underscores added until no column of the table has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def tokenizer_path(spark: SparkSession, name: str) -> str:
    """A public tokenizer's file, in the folder that spark.campaignlens.tokenizers names; the driver alone reads it."""
    return f"{spark.conf.get('spark.campaignlens.tokenizers', '/opt/tokenizers')}/{name}"


def slices(batches: Iterable[pa.RecordBatch], column: str, budget: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose texts hold about ``budget`` bytes; a longer text is alone in its run."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if i > start and held + size > budget:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if batch.num_rows > start:
            yield batch.slice(start)
