"""The corpus operators as named queries."""

from __future__ import annotations

from . import alignment, decontamination, jaccard, licences, mixing, packing, periodic, pii, quality, scoring, substrings, tokens, warc


def queries() -> dict:
    found = (
        packing.op1_best_fit_packing, substrings.op2_substring_dedup, scoring.op3_lm_scoring, decontamination.op4_decontamination,
        quality.op5_quality_rules, pii.op6_pii, warc.op7_warc_revisits, licences.op8_license_scans, jaccard.op9_ngram_jaccard_join, tokens.op10_token_counts,
        mixing.op11_source_mixing, alignment.op12_tokenizer_alignment, periodic.op13_periodic_runs,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op8_license_scans": licences.ORACLE}
