"""The numbered queries and, where SQL can state them, their oracles."""

from __future__ import annotations

from . import bpe, chat, exact_dedup, lm_scoring, merkle, mixing, packing, periodic, pii, quality_rules, simhash, substring_dedup, suffix_dedup

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_bpe": bpe.op2_bpe,
    "op3_mixing": mixing.op3_mixing,
    "op4_chat": chat.op4_chat,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_simhash": simhash.op6_simhash,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_lm_scoring": lm_scoring.op9_lm_scoring,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_merkle": merkle.op11_merkle,
    "op12_packing": packing.op12_packing,
    "op13_runs": periodic.op13_runs,
}

ORACLES = {
    "op4_chat": chat.OP4_SQL,
    "op5_substring_dedup": substring_dedup.OP5_SQL,
    "op3_mixing": mixing.OP3_SQL,
    "op8_quality_rules": quality_rules.OP8_SQL,
    "op10_exact_dedup": exact_dedup.OP10_SQL,
    "op11_merkle": merkle.OP11_SQL,
    "op13_runs": periodic.OP13_SQL,
}
