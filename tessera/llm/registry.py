"""Registered queries of this package and, where SQL can express them, their oracles."""

from __future__ import annotations

import corpus_pipeline
from tessera.llm import decontam, langid, packing, pii, simhash, suffix, tokencount, topk, toxicity, warc


def queries() -> dict:
    return {
        "op1_warc": warc.op1_warc,
        "op2_pii": pii.op2_pii,
        "op3_simhash_near_dedup": simhash.op3_simhash_near_dedup,
        "op4_suffix_array_dedup": suffix.op4_suffix_array_dedup,
        "op5_exact_topk": topk.op5_exact_topk,
        "op6_language_id": langid.op6_language_id,
        "op7_decontamination": decontam.op7_decontamination,
        "op8_token_counts": tokencount.op8_token_counts,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_best_fit_packing": packing.op10_best_fit_packing,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": warc.OP1_SQL, "op5_exact_topk": topk.OP5_SQL}
