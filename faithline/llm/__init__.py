"""Operators for large training-data pipelines. Nothing else in the package imports this one.

QUERIES maps a query's name to a function of (spark, sf_dir); ORACLES has DuckDB SQL for those that SQL expresses."""

from . import bpe, conversations, licenses, line_dedup, lm_score, main_text, minhash, mixing, pii, quality, token_counts, topk, whitening

QUERIES = {
    "op1_source_mixing": mixing.query,
    "op2_token_counts": token_counts.query,
    "op3_quality_rules": quality.query,
    "op4_byte_bpe": bpe.query,
    "op5_license_scan": licenses.query,
    "op6_exact_top_k": topk.query,
    "op7_pii": pii.query,
    "op8_line_dedup": line_dedup.query,
    "op9_lm_score": lm_score.query,
    "op10_minhash_near_dedup": minhash.query,
    "op11_embedding_whitening": whitening.query,
    "op12_conversation_repair": conversations.query,
    "op13_html_extraction": main_text.query,
}

ORACLES = {
    "op3_quality_rules": quality.ORACLE,
    "op6_exact_top_k": topk.ORACLE,
    "op10_minhash_near_dedup": minhash.ORACLE,
    "op12_conversation_repair": conversations.ORACLE,
}
