"""Queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from pagewright.llm import ann, chat, decontaminate, packing, pii, quality, sharding, simhash, toxicity, wavelet

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_pii": pii.op2_pii,
    "op3_chat_formatting": chat.op3_chat_formatting,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_sharding": sharding.op5_sharding,
    "op6_packing": packing.op6_packing,
    "op7_nearest_neighbours": ann.op7_nearest_neighbours,
    "op8_simhash_near_dedup": simhash.op8_simhash_near_dedup,
    "op9_token_files": wavelet.op9_token_files,
    "op10_toxicity": toxicity.op10_toxicity,
}

ORACLES: dict[str, str] = {"op3_chat_formatting": chat.ORACLE}
