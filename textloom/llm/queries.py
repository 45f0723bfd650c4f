"""The corpus operators' queries, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from . import classifier, html_text, katz_ngrams, licences, mixing, neighbours, packing, quality_rules, simhash, token_files

QUERIES = {
    "op1_simhash_near_dedup": simhash.query,
    "op2_quality_classifier": classifier.query,
    "op3_mix_sources": mixing.query,
    "op4_licence_scan": licences.query,
    "op5_katz_scores": katz_ngrams.query,
    "op6_html_extraction": html_text.query,
    "op7_nearest_neighbours": neighbours.query,
    "op8_llr_quality_rules": quality_rules.query,
    "op9_retrieval_packing": packing.query,
    "op10_token_files": token_files.query,
    "op4_licence_paragraphs": licences.query_paragraphs,
    "op5_katz_conversations": katz_ngrams.query_conversations,
}

ORACLE_SQL = {
    "op4_licence_scan": licences.SQL,
    "op8_llr_quality_rules": quality_rules.SQL,
}
