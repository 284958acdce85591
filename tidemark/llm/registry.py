"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, jaccard_join, licences, lm_scoring, mixing, pii, quality_model, quality_rules, toxicity, webp

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_quality_model": quality_model.op2_quality_model,
    "op3_lm_scoring": lm_scoring.op3_lm_scoring,
    "op4_ngram_jaccard": jaccard_join.op4_ngram_jaccard,
    "op5_pii": pii.op5_pii,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_webp": webp.op7_webp,
    "op8_bpe": bpe.op8_bpe,
    "op9_mixing": mixing.op9_mixing,
    "op10_licence_scan": licences.op10_licence_scan,
}

ORACLES = {"op1_quality_rules": quality_rules.ORACLE_OP1, "op10_licence_scan": licences.ORACLE_OP10}
