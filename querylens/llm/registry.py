"""The thin queries of this package over the standard tables, and their SQL where SQL can express them."""

from __future__ import annotations

from querylens.llm import decontaminate, html_extract, license_scan, line_dedup, mixing, ngram_join, ngram_lm, quality_rules, token_counts, toxicity


def queries() -> dict:
    return {
        "op1_ngram_join": ngram_join.op1_ngram_join,
        "op2_decontaminate": decontaminate.op2_decontaminate,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_mixing": mixing.op4_mixing,
        "op5_license_scan": license_scan.op5_license_scan,
        "op6_html_extract": html_extract.op6_html_extract,
        "op7_ngram_lm": ngram_lm.op7_ngram_lm,
        "op8_token_counts": token_counts.op8_token_counts,
        "op9_line_dedup": line_dedup.op9_line_dedup,
        "op10_quality_rules": quality_rules.op10_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": decontaminate.SQL, "op9_line_dedup": line_dedup.SQL, "op10_quality_rules": quality_rules.SQL}
