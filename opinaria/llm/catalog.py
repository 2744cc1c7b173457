"""The registered queries of the numbered operators, and their SQL."""
from __future__ import annotations

from . import bpe, embeddings, line_dedup, lm, minhash, mixing, negatives, quality, search, secrets, sharding, token_counts, toxicity


def queries() -> dict:
    return {
        "op1_lm_mixing": lm.query,
        "op2_mix_sources": mixing.query,
        "op3_quality_rules": quality.query,
        "op4_secret_scan": secrets.query,
        "op5_toxicity": toxicity.query,
        "op6_line_dedup": line_dedup.query,
        "op7_sharding": sharding.query,
        "op8_bpe": bpe.query,
        "op9_minhash": minhash.query,
        "op10_embedding_dedup": embeddings.query,
        "op11_token_counts": token_counts.query,
        "op12_hard_negatives": negatives.query,
        "op13_ranked_search": search.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_mix_sources": mixing.SQL, "op3_quality_rules": quality.SQL, "op4_secret_scan": secrets.SQL, "op6_line_dedup": line_dedup.SQL,
        "op9_minhash": minhash.SQL, "op10_embedding_dedup": embeddings.SQL, "op12_hard_negatives": negatives.SQL, "op13_ranked_search": search.SQL,
    }
