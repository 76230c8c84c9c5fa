"""The corpus pipeline: from raw documents to token ids in training order.

Each stage works on all that the one before it kept, is written as Parquet and read again.
All stages but the last return the columns of ``documents``; a text that a stage changes has
its ``n_chars`` counted anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from campaignlens.llm.lines import dedup_lines
from campaignlens.llm.mixing import mix_sources
from campaignlens.llm.mixing_queries import BLOCK_DOCS, REST_WEIGHT, SEED, TARGET_WEIGHTS
from campaignlens.llm.pieces import PieceModel, decode_ids, encode_texts
from campaignlens.llm.quality import THRESHOLD, fit_quality, fold, score_quality
from campaignlens.llm.simhash import keep_one
from campaignlens.llm.texts import free_name
from campaignlens.llm.token_queries import model_path
from campaignlens.session import shared_dir
from campaignlens.sources.readers import read_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject, unchanged.

    The classifier learns from the labels outside fold 0 of 5, as its own query does. Null and
    empty texts are scored like others; without labels nothing is rejected.
    """
    net = fit_quality(docs, read_table(spark, sf_dir, "labels"), learn=fold("doc_id", 5) != 0)
    score = free_name(docs, "score")
    return score_quality(docs, net).where(F.col(score) >= THRESHOLD).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the long lines that five or more of them share; one document keeps each line.

    Every document stays, an emptied one with the empty text; a null text becomes empty.
    """
    cleaned = dedup_lines(docs, min_chars=40, min_docs=5)
    return cleaned.select(
        *[F.char_length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else c for c in docs.columns]
    )


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose SimHash fingerprints link, the one with the smallest id.

    Empty texts are one group. Rows without an id stay only where their group has none with one.
    """
    return keep_one(docs, words=3, max_bits=2)


def _mixed(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """The documents with their block's slot and their place in it, and the names of these columns."""
    slot, place = (free_name(docs, c) for c in ("mix_slot", "mix_place"))
    return mix_sources(docs, TARGET_WEIGHTS, REST_WEIGHT, BLOCK_DOCS, SEED), slot, place


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix: its files, read in the order of their names, are the mix.

    Every prefix up to the end of the first source is within a block of the target weights.
    """
    mixed, slot, place = _mixed(docs)
    return mixed.orderBy(slot, place).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ``ids``, ``n_tokens``, ``round_trip`` (whether the ids decode to the text), ``mix_slot`` and ``mix_place``.

    A null text has null ids and no tokens. Documents have no column for the mix, and files
    are not read in the order of their names, so slot and place are worked out again from the
    same documents. Rows come sorted by them: the files in the order of their names are the mix.
    """
    model = PieceModel.load(model_path(spark))
    mixed, slot, place = _mixed(docs)
    slim = mixed.select("doc_id", "source", "text", F.col(slot).alias("mix_slot"), F.col(place).alias("mix_place"))
    both = decode_ids(encode_texts(slim, model), model)
    return both.select(
        "doc_id",
        "source",
        "ids",
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
        "mix_slot",
        "mix_place",
    ).orderBy("mix_slot", "mix_place")


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_stage),
    ("source mixing", mixing_stage),
    ("SentencePiece", token_stage),
]

# Trained scores and piece ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; each result is written to the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_dir(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
