"""The queries of this subpackage and the SQL that states their results."""

from __future__ import annotations

import corpus_pipeline
from loomline.llm import decontamination, jaccard, language_model, mixing, pii, quality, secrets, suffix_dedup, token_counts, toxicity

QUERIES = {
    "op1_source_mix": mixing.query,
    "op2_toxicity": toxicity.query,
    "op3_secret_scan": secrets.query,
    "op4_decontamination": decontamination.query,
    "op5_token_counts": token_counts.query,
    "op6_jaccard_groups": jaccard.query,
    "op7_pii_pseudonyms": pii.query,
    "op8_suffix_dedup": suffix_dedup.query,
    "op9_quality_rules": quality.query,
    "op10_language_model": language_model.query,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op1_source_mix": mixing.oracle(),
    "op4_decontamination": decontamination.oracle(),
    "op6_jaccard_groups": jaccard.oracle(),
    "op9_quality_rules": quality.oracle(),
}
