"""Queries of the training-data operators and their DuckDB counterparts."""

from __future__ import annotations

from webloom.llm import decontaminate, html_text, jaccard_join, language, lexical, licenses, line_dedup, media, minhash_bayes, mixing, pii, quality, resample

QUERIES = {
    "op1_license_scan": licenses.query,
    "op2_language_id": language.query,
    "op3_source_mixing": mixing.query,
    "op4_jaccard_join": jaccard_join.query,
    "op5_line_dedup": line_dedup.query,
    "op6_html_extraction": html_text.query,
    "op7_media_columns": media.query,
    "op8_quality": quality.query,
    "op9_decontamination": decontaminate.query,
    "op10_pii": pii.query,
    "op11_importance_resampling": resample.query,
    "op12_lexical_search": lexical.query,
    "op13_minhash_dedup": minhash_bayes.query,
}

ORACLE_SQL: dict[str, str] = {
    "op3_source_mixing": mixing.SQL,
    "op5_line_dedup": line_dedup.SQL,
    "op9_decontamination": decontaminate.SQL,
    "op11_importance_resampling": resample.SQL,
    "op12_lexical_search": lexical.SQL,
    "op13_minhash_dedup": minhash_bayes.SQL,
}
