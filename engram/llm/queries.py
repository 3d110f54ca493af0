"""The registered queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import clustering, decontamination, exact_dedup, jaccard_join, line_dedup, mixing, packing, quality, sharding, spelling, substring_dedup, token_counts, token_output

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_ngram_jaccard_join": jaccard_join.op2_ngram_jaccard_join,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_token_output": token_output.op4_token_output,
    "op5_mixing": mixing.op5_mixing,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_quality_classifier": quality.op8_quality_classifier,
    "op9_decontamination": decontamination.op9_decontamination,
    "op10_sharding": sharding.op10_sharding,
    "op11_centroid_clustering": clustering.op11_centroid_clustering,
    "op12_packing": packing.op12_packing,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}

ORACLES = {
    "op2_ngram_jaccard_join": jaccard_join.ORACLE,
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op5_mixing": mixing.ORACLE,
    "op7_line_dedup": line_dedup.ORACLE,
    "op11_centroid_clustering": clustering.ORACLE,
}
