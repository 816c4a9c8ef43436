"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import fingerprints, licenses, lm_scoring, mixing, ngram_join, packing, quality, suffix_dedup, token_counts, toxicity

QUERIES = {
    "op1_licenses": licenses.op1_licenses,
    "op2_mixing": mixing.op2_mixing,
    "op3_lm_scoring": lm_scoring.op3_lm_scoring,
    "op4_fingerprints": fingerprints.op4_fingerprints,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_ngram_join": ngram_join.op6_ngram_join,
    "op7_packing": packing.op7_packing,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_quality": quality.op9_quality,
    "op10_toxicity": toxicity.op10_toxicity,
    "minhash_pairs": fingerprints.minhash_pairs,
    "mixing_targets": mixing.mixing_targets,
    "quality_measures": quality.quality_measures,
}

ORACLE_SQL: dict[str, str] = {"op1_licenses": licenses.oracle(), "op6_ngram_join": ngram_join.oracle(), "minhash_pairs": fingerprints.pairs_oracle(), "mixing_targets": mixing.targets_sql(), "quality_measures": quality.MEASURES_SQL}
