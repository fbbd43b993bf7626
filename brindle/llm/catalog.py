"""The queries of the text operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from brindle.llm import collocations, divergence, html_extract, language_id, line_dedup, media, mixing, packing, quality_classifier, quality_rules, simhash, substring_dedup, token_store


def queries() -> dict:
    return {
        "op1_quality_rules": quality_rules.query,
        "op2_mixing": mixing.query,
        "op3_token_store": token_store.query,
        "op4_html_extract": html_extract.query,
        "op5_line_dedup": line_dedup.query,
        "op6_quality_classifier": quality_classifier.query,
        "op7_language_id": language_id.query,
        "op8_simhash": simhash.query,
        "op9_media": media.query,
        "op10_packing": packing.query,
        "op11_divergence": divergence.query,
        "op12_substring_dedup": substring_dedup.query,
        "op13_collocations": collocations.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality_rules.oracle(),
        "op5_line_dedup": line_dedup.oracle(),
        "op11_divergence": divergence.oracle(),
        "op12_substring_dedup": substring_dedup.oracle(),
        "op13_collocations": collocations.oracle(),
    }
