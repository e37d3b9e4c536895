"""The registered queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from . import chat_format, collocations, decontaminate, filter_audit, html_extract, jaccard_join, line_dedup, packing, quality_classifier, quality_rules, token_count, toxicity, url_filter

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op2_token_counts": token_count.query,
    "op3_quality_classifier": quality_classifier.query,
    "op4_quality_rules": quality_rules.query,
    "op5_chat_formatting": chat_format.query,
    "op6_ngram_jaccard_join": jaccard_join.query,
    "op7_url_filters": url_filter.query,
    "op8_benchmark_decontamination": decontaminate.query,
    "op9_best_fit_packing": packing.query,
    "op10_toxicity": toxicity.query,
    "op11_html_extraction": html_extract.query,
    "op12_collocations": collocations.query,
    "op13_filter_interaction_audit": filter_audit.query,
}

ORACLE = {
    "op1_line_dedup": line_dedup.SQL,
    "op5_chat_formatting": chat_format.SQL,
    "op7_url_filters": url_filter.SQL,
    "op8_benchmark_decontamination": decontaminate.SQL,
    "op12_collocations": collocations.SQL,
    "op13_filter_interaction_audit": filter_audit.SQL,
}
