"""The queries of this subpackage: one for each operator, and the pipeline."""

from __future__ import annotations

from . import byte_bpe, decontamination, embedding_whitening, lm_scoring, near_dedup, periodic_runs, pii_surrogates, quality_classifier, quality_rules, secret_scan, sharding, substring_dedup, token_counts

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_lm_scoring": lm_scoring.op3_lm_scoring,
    "op4_pii_surrogates": pii_surrogates.op4_pii_surrogates,
    "op5_decontamination": decontamination.op5_decontamination,
    "op6_sharding": sharding.op6_sharding,
    "op7_byte_bpe": byte_bpe.op7_byte_bpe,
    "op8_secret_scan": secret_scan.op8_secret_scan,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_quality_classifier": quality_classifier.op12_quality_classifier,
    "op13_embedding_whitening": embedding_whitening.op13_embedding_whitening,
}
SQL = {
    "op2_substring_dedup": substring_dedup.SQL,
    "op5_decontamination": decontamination.SQL,
    "op6_sharding": sharding.SQL,
    "op9_near_dedup": near_dedup.SQL,
    "op10_quality_rules": quality_rules.SQL,
    "op11_periodic_runs": periodic_runs.SQL,
}
