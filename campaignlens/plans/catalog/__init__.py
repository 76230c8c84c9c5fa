"""Checked queries: each pairs a Spark query with the SQL that must agree with it."""

from campaignlens.plans.catalog import (  # noqa: F401
    evaluation_queries,
    model_queries,
    preparation_queries,
    profile_queries,
    ranking_queries,
    rate_queries,
    rule_queries,
    segment_queries,
    source_queries,
    stream_queries,
    table_queries,
)
from campaignlens.plans.catalog.common import ORACLES, QUERIES  # noqa: F401
