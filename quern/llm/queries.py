"""The queries of the corpus operators, and their SQL where SQL can express them."""

from quern.llm import byte_bpe, exact_dedup, line_dedup, mixing, quality, rp_forest, simhash_dedup, substring_dedup, suffix_lm, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op10_quality": quality.op10_quality,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_rp_forest": rp_forest.op4_rp_forest,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_suffix_tree_lm": suffix_lm.op6_suffix_tree_lm,
    "op7_byte_bpe": byte_bpe.op7_byte_bpe,
    "op8_simhash_dedup": simhash_dedup.op8_simhash_dedup,
    "op2_source_mixing": mixing.op2_source_mixing,
}
ORACLES = {"op9_exact_dedup": exact_dedup.OP9_SQL, "op5_substring_dedup": substring_dedup.OP5_SQL}
