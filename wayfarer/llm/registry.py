"""Queries of this package and, where SQL can express them, their DuckDB text."""

from __future__ import annotations

from wayfarer.llm import (embedding_dedup, html_text, language_id, lexical_search, minhash_dedup,
                          mixing, packing, quality_classifier, quality_rules, suffix_dedup,
                          url_filters, warc_audit, word_runs)

QUERIES = {
    "op1_url_filters": url_filters.query,
    "op2_warc_audit": warc_audit.query,
    "op3_embedding_dedup": embedding_dedup.query,
    "op4_suffix_dedup": suffix_dedup.query,
    "op5_packing": packing.query,
    "op6_language_id": language_id.query,
    "op7_minhash_dedup": minhash_dedup.query,
    "op8_quality_rules": quality_rules.query,
    "op9_mixing": mixing.query,
    "op10_quality_classifier": quality_classifier.query,
    "op11_html_text": html_text.query,
    "op12_lexical_search": lexical_search.query,
    "op13_word_runs": word_runs.query,
}

ORACLE_SQL = {
    "op1_url_filters": url_filters.ORACLE_SQL,
    "op2_warc_audit": warc_audit.ORACLE_SQL,
    "op9_mixing": mixing.ORACLE_SQL,
    "op12_lexical_search": lexical_search.ORACLE_SQL,
}
