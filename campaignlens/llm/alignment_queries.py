"""The query of the token alignment, tested by brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from campaignlens.llm.alignment import Pieces, align_tokens
from campaignlens.llm.byte_pairs import BytePairs
from campaignlens.llm.registry import query
from campaignlens.llm.texts import tokenizer_path
from campaignlens.sources.readers import read_table

TOKENIZERS = ("byte_bpe_50k.json", "piece_bpe_32k.model")


@query("op11_token_alignment")
def op11_token_alignment(spark, sf_dir):
    a, b = (tokenizer_path(spark, name) for name in TOKENIZERS)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = align_tokens(docs, BytePairs.load(a, plain=True), Pieces.load(b))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))
