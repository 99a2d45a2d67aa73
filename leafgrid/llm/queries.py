"""The queries of this subpackage, by name, and their SQL where SQL can say the same."""

from __future__ import annotations

from leafgrid.llm import (
    fingerprints,
    html_extraction,
    language_model,
    near_duplicates,
    packing,
    quality_classifier,
    quality_rules,
    sentence_pieces,
    sharding,
    token_counts,
)

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_html_extraction": html_extraction.op2_html_extraction,
    "op3_ngram_jaccard_join": near_duplicates.op3_ngram_jaccard_join,
    "op4_lm_scoring": language_model.op4_lm_scoring,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_document_fingerprints": fingerprints.op6_document_fingerprints,
    "op7_quality_classifier": quality_classifier.op7_quality_classifier,
    "op8_sharding": sharding.op8_sharding,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_sentencepiece_coding": sentence_pieces.op10_sentencepiece_coding,
}
ORACLES = {
    "op1_quality_rules": quality_rules.oracle(),
}
