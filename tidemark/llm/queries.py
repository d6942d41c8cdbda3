"""The driver's queries over the operators of this subpackage, and their DuckDB equivalents."""

from __future__ import annotations

from tidemark.llm import ann, chat, decontaminate, jaccard, lm, pieces, sharding, tokens, toxicity, url_filter

QUERIES = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_sentencepiece": pieces.op3_sentencepiece,
    "op4_token_counts": tokens.op4_token_counts,
    "op5_nearest_vectors": ann.op5_nearest_vectors,
    "op6_lm_scores": lm.op6_lm_scores,
    "op7_jaccard_classes": jaccard.op7_jaccard_classes,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_perspectives": chat.op9_perspectives,
    "op10_hilbert_sharding": sharding.op10_hilbert_sharding,
}
ORACLES = {
    "op1_decontamination": decontaminate.ORACLE_OP1,
    "op8_url_filter": url_filter.ORACLE_OP8,
    "op9_perspectives": chat.ORACLE_OP9,
}
