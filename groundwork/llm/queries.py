"""All registered queries of this subpackage."""

from groundwork.llm import (  # noqa: F401
    clustering,
    conversations,
    decontamination,
    exact_dedup,
    jaccard_join,
    licenses,
    line_dedup,
    packing,
    quality_rules,
    sharding,
    substring_dedup,
    token_counts,
    toxicity,
)
from groundwork.llm.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
