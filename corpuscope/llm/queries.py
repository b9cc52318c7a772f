"""The queries of this subpackage, and their SQL."""

from __future__ import annotations

from . import chat, decontam, dedup, jaccard, langid, lm, mixing, neighbours, pii, toxicity


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_pii": pii.op2_pii,
        "op3_lm_scoring": lm.op3_lm_scoring,
        "op6_decontamination": decontam.op6_decontamination,
        "op4_chat_formatting": chat.op4_chat_formatting,
        "op5_language_id": langid.op5_language_id,
        "op7_source_mixing": mixing.op7_source_mixing,
        "op8_ngram_jaccard": jaccard.op8_ngram_jaccard,
        "op9_repeat_removal": dedup.op9_repeat_removal,
        "op10_neighbours": neighbours.op10_neighbours,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_decontamination": decontam.sql(), "op7_source_mixing": mixing.sql(), "op8_ngram_jaccard": jaccard.sql(), "op9_repeat_removal": dedup.sql()}
