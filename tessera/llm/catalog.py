"""The corpus operators' queries by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, decontaminate, html_text, imatch, jaccard_join, language, ngram_lm, suffix_dedup, url_filter, warc

QUERIES = {
    "op1_url_filters": url_filter.op1_url_filters,
    "op2_jaccard_join": jaccard_join.op2_jaccard_join,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_html_extraction": html_text.op4_html_extraction,
    "op5_bpe": bpe.op5_bpe,
    "op6_decontamination": decontaminate.op6_decontamination,
    "op7_lm_scoring": ngram_lm.op7_lm_scoring,
    "op8_warc": warc.op8_warc,
    "op9_language_id": language.op9_language_id,
    "op10_fingerprints": imatch.op10_fingerprints,
}
ORACLE = {
    "op1_url_filters": url_filter.SQL,
    "op6_decontamination": decontaminate.SQL,
    "op8_warc": warc.SQL,
}
