"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from . import (
    decontamination,
    importance_resampling,
    jaccard_join,
    line_dedup,
    packing,
    ppm,
    quality_classifier,
    quality_rules,
    source_divergence,
    substring_dedup,
    suffix_dedup,
    token_rollup,
    url_filters,
)

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_token_counts": token_rollup.op3_token_counts,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
    "op7_ppm": ppm.op7_ppm,
    "op8_quality_classifier": quality_classifier.op8_quality_classifier,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op11_source_divergence": source_divergence.op11_source_divergence,
    "op12_importance_resampling": importance_resampling.op12_importance_resampling,
    "op13_url_filters": url_filters.op13_url_filters,
}

SQL = {
    "op5_quality_rules": quality_rules.SQL,
    "op6_line_dedup": line_dedup.SQL,
    "op11_source_divergence": source_divergence.SQL,
    "op12_importance_resampling": importance_resampling.SQL,
    "op13_url_filters": url_filters.SQL,
}
