"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from spendlens.llm import (es_mixing, langid, line_edit_dedup, pivot_index, pu_quality, quality_rules, secret_ledger,
                           simhash_golay, source_audit, token_alignment, toxicity, vector_packing, warc_chunks)

QUERIES = {
    "op1_quality_rules": quality_rules.query,
    "op2_language_id": langid.query,
    "op3_simhash_golay": simhash_golay.query,
    "op4_vector_packing": vector_packing.query,
    "op5_secret_ledger": secret_ledger.query,
    "op6_pu_quality": pu_quality.query,
    "op7_warc_chunks": warc_chunks.query,
    "op8_line_edit_dedup": line_edit_dedup.query,
    "op9_pivot_index": pivot_index.query,
    "op10_es_mixing": es_mixing.query,
    "op11_token_alignment": token_alignment.query,
    "op12_source_audit": source_audit.query,
    "op13_toxicity": toxicity.query,
    "quality_rule_ablations": quality_rules.ablation_query,
}

ORACLE = {
    "op1_quality_rules": quality_rules.SQL,
    "op5_secret_ledger": secret_ledger.SQL,
    "op7_warc_chunks": warc_chunks.SQL,
    "op9_pivot_index": pivot_index.SQL,
    "op10_es_mixing": es_mixing.SQL,
    "op12_source_audit": source_audit.SQL,
    "quality_rule_ablations": quality_rules.ABLATION_SQL,
}
