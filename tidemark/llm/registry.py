"""Queries of the training-data operators and the DuckDB oracles of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from tidemark.llm import exact_dedup, language_id, lm_score, merkle, near_dedup, packing, quality, sharding, token_files, viterbi

QUERIES = {
    "op1_merkle": merkle.query,
    "op2_sharding": sharding.query,
    "op3_near_dedup": near_dedup.query,
    "op4_viterbi": viterbi.query,
    "op5_token_files": token_files.query,
    "op6_exact_dedup": exact_dedup.query,
    "op7_language_id": language_id.query,
    "op8_quality": quality.query,
    "op9_packing": packing.query,
    "op10_lm_score": lm_score.query,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {"op3_near_dedup": near_dedup.ORACLE, "op6_exact_dedup": exact_dedup.ORACLE}
