"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from onsetframe.llm import cotraining, hard_negatives, jaccard, lm_scoring, mixing, multi_index, packing, phrases, quality_rules, secrets, sharding, style_tree, toxicity

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_packing": packing.op4_packing,
    "op5_cotraining": cotraining.op5_cotraining,
    "op6_multi_index": multi_index.op6_multi_index,
    "op7_cross_entropy": lm_scoring.op7_cross_entropy,
    "op8_histogram_sort": sharding.op8_histogram_sort,
    "op9_site_style_tree": style_tree.op9_site_style_tree,
    "op10_ngram_jaccard": jaccard.op10_ngram_jaccard,
    "op11_toxicity": toxicity.op11_toxicity,
    "op12_phrases": phrases.op12_phrases,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {"op1_mixing": mixing.SQL, "op12_phrases": phrases.SQL, "op13_hard_negatives": hard_negatives.SQL}
