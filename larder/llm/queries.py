"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from . import bloom_lm, collision_search, collocations, decontaminate, fill_middle, language_id, line_dedup, near_dedup, quality_rules, sentencepiece_bpe, substring_dedup, token_count, toxicity

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_token_count": token_count.op2_token_count,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_sentencepiece": sentencepiece_bpe.op4_sentencepiece,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_lm_score": bloom_lm.op7_lm_score,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_language_id": language_id.op10_language_id,
    "op11_nearest": collision_search.op11_nearest,
    "op12_collocations": collocations.op12_collocations,
    "op13_fill_in_middle": fill_middle.op13_fill_in_middle,
}

SQL = {
    "op1_decontaminate": decontaminate.SQL,
    "op3_substring_dedup": substring_dedup.SQL,
    "op9_line_dedup": line_dedup.SQL,
    "op12_collocations": collocations.SQL,
    "op13_fill_in_middle": fill_middle.SQL,
}
