"""The query of the SentencePiece operators, tested by brute force and exact round trip."""

from __future__ import annotations

from pyspark.sql import functions as F

from campaignlens.llm.pieces import PieceModel, decode_ids, encode_texts
from campaignlens.llm.registry import query
from campaignlens.sources.readers import read_table

MODEL = "piece_bpe_32k.model"


def model_path(spark) -> str:
    """The model file, in the folder that campaignlens.tokenizers names; the driver alone reads it."""
    return f"{spark.conf.get('spark.campaignlens.tokenizers', '/opt/tokenizers')}/{MODEL}"


@query("op5_sentencepiece")
def op5_sentencepiece(spark, sf_dir):
    model = PieceModel.load(model_path(spark))
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    both = decode_ids(encode_texts(docs, model), model)
    return both.select(
        "doc_id",
        "ids",
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )
