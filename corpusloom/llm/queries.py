"""Queries of the training-data operators and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from . import op1_tokens, op10_neighbours, op11_runs, op12_classifier, op13_divergence, op2_secrets, op3_mixing, op4_quality, op5_bpe, op6_toxicity, op7_simhash, op8_counts, op9_warc

QUERIES = {
    "op1_token_files": op1_tokens.op1_token_files,
    "op2_secret_scan": op2_secrets.op2_secret_scan,
    "op3_poisson_mixing": op3_mixing.op3_poisson_mixing,
    "op4_quality_rules": op4_quality.op4_quality_rules,
    "op5_byte_bpe": op5_bpe.op5_byte_bpe,
    "op6_toxicity": op6_toxicity.op6_toxicity,
    "op7_simhash_near_dedup": op7_simhash.op7_simhash_near_dedup,
    "op8_token_counts": op8_counts.op8_token_counts,
    "op9_warc": op9_warc.op9_warc,
    "op10_nearest_neighbours": op10_neighbours.op10_nearest_neighbours,
    "op11_periodic_runs": op11_runs.op11_periodic_runs,
    "op12_quality_classifier": op12_classifier.op12_quality_classifier,
    "op13_source_divergence": op13_divergence.op13_source_divergence,
    "quality_rule_counts": op4_quality.quality_rule_counts,
}

SQL = {
    "op2_secret_scan": op2_secrets.SQL,
    "op3_poisson_mixing": op3_mixing.SQL,
    "op9_warc": op9_warc.SQL,
    "op11_periodic_runs": op11_runs.SQL,
    "op13_source_divergence": op13_divergence.SQL,
    "quality_rule_counts": op4_quality.SQL,
}
