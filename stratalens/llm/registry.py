"""The queries and oracle SQL of this subpackage, for the entry point."""

from __future__ import annotations

from stratalens.llm import chat, decontaminate, divergence, fim, huffman, langid, lines, lm, neardup, packing, pii, quality, warc

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_near_duplicates": neardup.op3_near_duplicates,
    "op4_line_dedup": lines.op4_line_dedup,
    "op5_preference_formatting": chat.op5_preference_formatting,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_packing": packing.op7_packing,
    "op8_token_files": huffman.op8_token_files,
    "op9_warc": warc.op9_warc,
    "op10_lm_scores": lm.op10_lm_scores,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_language_id": langid.op12_language_id,
    "op13_fill_in_middle": fim.op13_fill_in_middle,
}
ORACLES = {
    "op1_pii": pii.ORACLE,
    "op5_preference_formatting": chat.ORACLE,
    "op6_quality_rules": quality.ORACLE,
    "op9_warc": warc.ORACLE,
    "op11_source_divergence": divergence.ORACLE,
    "op13_fill_in_middle": fim.ORACLE,
}
