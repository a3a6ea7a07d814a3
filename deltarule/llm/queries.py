"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from deltarule.llm import bpe, language_id, mixing, quality_classifier, quality_rules, simhash, substring_dedup, suffix_dedup, topk, url_filter

QUERIES = {
    "op1_substring_dedup": substring_dedup.query,
    "op2_suffix_array_dedup": suffix_dedup.query,
    "op3_compression_bands": quality_rules.query,
    "op4_compression_classifier": quality_classifier.query,
    "op5_language_id": language_id.query,
    "op6_simhash_golay": simhash.query,
    "op7_byte_bpe": bpe.query,
    "op8_source_mixing": mixing.query,
    "op9_url_filters": url_filter.query,
    "op10_voronoi_topk": topk.query,
}
SQL = {
    "op1_substring_dedup": substring_dedup.SQL,
    "op8_source_mixing": mixing.SQL,
    "op9_url_filters": url_filter.SQL,
    "op10_voronoi_topk": topk.SQL,
}
