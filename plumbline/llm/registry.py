"""Queries of this subpackage with their SQL counterparts (None where SQL cannot express them)."""

from __future__ import annotations

import corpus_pipeline
from plumbline.llm import (
    conversation_repair,
    mixing,
    ngram_join,
    packing,
    periodic_runs,
    personal_data,
    quality_classifier,
    quality_rules,
    sharding,
    substring_dedup,
    suffix_dedup,
    token_counts,
    topk_search,
)

QUERIES = {
    "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
    **suffix_dedup.QUERIES,
    **ngram_join.QUERIES,
    **packing.QUERIES,
    **mixing.QUERIES,
    **substring_dedup.QUERIES,
    **token_counts.QUERIES,
    **topk_search.QUERIES,
    **quality_classifier.QUERIES,
    **quality_rules.QUERIES,
    **sharding.QUERIES,
    **personal_data.QUERIES,
    **conversation_repair.QUERIES,
    **periodic_runs.QUERIES,
}
