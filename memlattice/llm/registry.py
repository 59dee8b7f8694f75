"""The queries of this package, one per operator and one for the ablations of the quality rules, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from . import audio_features, filter_audit, importance_resampling, jaccard_join, language_id, line_dedup, periodic_runs, quality_rules, sentencepiece_codec, simhash, source_mix, toxicity, url_filter
from .common import table

QUERIES = {
    "op1_importance_resampling": lambda spark, d: importance_resampling.op1(table(spark, d, "documents"), table(spark, d, "labels")),
    "op2_simhash_near_dedup": lambda spark, d: simhash.op2(table(spark, d, "documents")),
    "op3_toxicity": lambda spark, d: toxicity.op3(table(spark, d, "documents"), table(spark, d, "labels")),
    "op4_quality_rules": lambda spark, d: quality_rules.op4(table(spark, d, "documents")),
    "op5_sentencepiece": lambda spark, d: sentencepiece_codec.op5(table(spark, d, "documents")),
    "op6_source_mix": lambda spark, d: source_mix.op6(table(spark, d, "documents")),
    "op7_language_id": lambda spark, d: language_id.op7(table(spark, d, "documents")),
    "op8_line_dedup": lambda spark, d: line_dedup.op8(table(spark, d, "documents")),
    "op9_audio_features": lambda spark, d: audio_features.op9(table(spark, d, "documents")),
    "op10_url_filter": lambda spark, d: url_filter.op10(table(spark, d, "pages")),
    "op11_periodic_runs": lambda spark, d: periodic_runs.op11(table(spark, d, "documents")),
    "op12_filter_audit": lambda spark, d: filter_audit.op12(table(spark, d, "documents"), table(spark, d, "labels")),
    "op13_ngram_jaccard": lambda spark, d: jaccard_join.op13(table(spark, d, "documents")),
    "quality_ablation": lambda spark, d: quality_rules.ablation(table(spark, d, "documents")),
}

ORACLES = {
    "op4_quality_rules": quality_rules.ORACLE,
    "quality_ablation": quality_rules.ABLATION_ORACLE,
    "op6_source_mix": source_mix.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
    "op12_filter_audit": filter_audit.ORACLE,
}
