"""Operators for preparing training data: mixing, archives, chat, language, tokens, quality and duplicates."""

from campaignlens.llm import (  # noqa: F401
    alignment_queries,
    chat_queries,
    dedup_queries,
    learned_queries,
    mixing_queries,
    model_queries,
    packing_queries,
    resampling_queries,
    token_queries,
    warc_queries,
)
from campaignlens.llm.registry import ORACLES, QUERIES  # noqa: F401
