"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from tokenledger.llm import decontamination, fill_middle, filter_audit, html_text, jaccard, language_id, line_dedup, mixing, neighbours, sharding, substring_dedup, toxicity, warc

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_nearest_neighbours": neighbours.op2_nearest_neighbours,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_jaccard_join": jaccard.op5_jaccard_join,
    "op6_warc": warc.op6_warc,
    "op7_language_id": language_id.op7_language_id,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_decontaminate": decontamination.op9_decontaminate,
    "op10_html_text": html_text.op10_html_text,
    "op11_fill_middle": fill_middle.op11_fill_middle,
    "op12_shard": sharding.op12_shard,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

ORACLES = {"op5_jaccard_join": jaccard.ORACLE_SQL, "op9_decontaminate": decontamination.ORACLE_SQL, "op11_fill_middle": fill_middle.ORACLE_SQL, "op13_filter_audit": filter_audit.ORACLE_SQL}
