"""The registered queries of the training-data operators, and SQL for those that it can express."""

from __future__ import annotations

from . import op1_quality_crf, op2_token_counts, op3_secret_scan, op4_ball_tree, op5_jaccard_join, op6_packing, op7_pii, op8_license_scan, op9_bpe_sql, op10_quality_rules, op11_sentencepiece, op12_periodic_runs, op13_vector_codes

QUERIES = {
    "op1_quality_crf": op1_quality_crf.op1_quality_crf,
    "op2_token_counts": op2_token_counts.op2_token_counts,
    "op3_secret_scan": op3_secret_scan.op3_secret_scan,
    "op4_ball_tree": op4_ball_tree.op4_ball_tree,
    "op5_jaccard_join": op5_jaccard_join.op5_jaccard_join,
    "op6_packing": op6_packing.op6_packing,
    "op7_pii": op7_pii.op7_pii,
    "op8_license_scan": op8_license_scan.op8_license_scan,
    "op9_bpe_sql": op9_bpe_sql.op9_bpe_sql,
    "op10_quality_rules": op10_quality_rules.op10_quality_rules,
    "op11_sentencepiece": op11_sentencepiece.op11_sentencepiece,
    "op12_periodic_runs": op12_periodic_runs.op12_periodic_runs,
    "op13_vector_codes": op13_vector_codes.op13_vector_codes,
}

ORACLES = {"op4_ball_tree": op4_ball_tree.ORACLE, "op8_license_scan": op8_license_scan.ORACLE, "op10_quality_rules": op10_quality_rules.ORACLE, "op13_vector_codes": op13_vector_codes.ORACLE}
