"""Quality of whole texts by a byte-level convolutional network trained on labelled documents."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from campaignlens.llm.cnn import Network, train
from campaignlens.llm.texts import free_name, slices
from campaignlens.session import discard, written

# Bounds of the training sample: documents of each label, and bytes of a document.
MAX_PER_LABEL, MAX_BYTES = 2_500, 1 << 16
THRESHOLD = 0.3


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null without an id."""
    return F.crc32(F.col(id_col).cast("string")) % folds


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_per_label: int = MAX_PER_LABEL,
    max_bytes: int = MAX_BYTES,
    **settings,
) -> Network:
    """A network fitted on a bounded sample of the labelled documents.

    ``learn`` restricts the labels (an expression over their columns). Labels other than 0
    and 1 are ignored; of several labels of an id the smallest counts. About
    ``max_per_label`` documents of each label are drawn by the md5 of their id, those longer
    than ``max_bytes`` are not learned from, and weights restore the share of the labels.
    Equal texts of an id are one example that counts as often as it occurs; where ids have
    so many texts that examples exceed that number, they are drawn by the md5 of id and text.
    The sample alone comes to the driver. Without labels the network is a constant.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    known = known.where(learn) if learn is not None else known
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    draw = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("long")
    share = {label: min(1.0, max_per_label / n) for label, n in counts.items()}
    drawn = known.where(
        F.lit(False)
        if not share
        else F.greatest(*[(F.col("label") == label) & (draw < int(s * (1 << 32))) for label, s in share.items()], F.lit(False))
    )
    # One row per id and text, as an id may have any number of rows.
    texts = written(
        docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
        .where(F.octet_length("text") <= max_bytes)
        .join(F.broadcast(drawn), F.col("key") == F.col("id"))
        .groupBy("key", "label", "text")
        .agg(F.count("*").alias("copies")),
        "examples",
    )
    sizes = texts.groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("key").alias("ids")).collect()
    part = {r["label"]: min(1.0, max(max_per_label, r["ids"]) / r["n"]) for r in sizes}
    again = F.conv(F.substring(F.md5(F.concat(F.col("key").cast("string"), F.lit(" "), F.md5("text"))), 1, 8), 16, 10).cast("long")
    limit = F.coalesce(*[F.when(F.col("label") == label, F.lit(int(p * (1 << 32)))) for label, p in part.items()], F.lit(0))
    # At most about two times max_per_label narrow rows.
    sample = texts.where(again < limit).toArrow().to_pylist()
    discard(texts)
    sample.sort(key=lambda r: (r["key"], r["text"]))
    target = np.array([float(r["label"]) for r in sample])
    weights = np.array([r["copies"] / share[r["label"]] / part[r["label"]] for r in sample])
    return train([r["text"] for r in sample], target, weights, **settings)


def score_quality(
    docs: DataFrame, net: Network, text_col: str = "text", score_col: str = "score", keep_text: bool = True
) -> DataFrame:
    """The table (without its text if not ``keep_text``) with a probability as ``score_col``.

    If the name is taken, underscores are added to it. The whole text is read; a null text
    scores as the empty one. Every row is scored by its text alone, so repeated rows score
    alike; an empty table stays empty.
    """
    name = free_name(docs, score_col)
    rest = [c for c in docs.columns if keep_text or c != text_col]
    schema = T.StructType([*[docs.schema[c] for c in rest], T.StructField(name, T.DoubleType(), False)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            texts = [t or b"" for t in batch.column(text_col).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(net.scores(texts))], names=schema.names)

    return docs.mapInArrow(run, schema)
