"""The operators of this folder, applied to the tables they are meant for."""

from __future__ import annotations

from . import bpe, centroids, chat, divergence, fingerprints, grammar, html_text, lattice, packing, quality, simhash, topk, toxicity
from .common import table


def queries() -> dict:
    return {
        "op1_html_extraction": lambda s, d: html_text.extract(table(s, d, "pages")),
        "op2_packing": lambda s, d: packing.pack(table(s, d, "documents")),
        "op3_exact_topk": lambda s, d: topk.topk_query(table(s, d, "embeddings")),
        "op4_toxicity": lambda s, d: toxicity.toxicity_query(table(s, d, "documents"), table(s, d, "labels")),
        "op5_simhash_near_dedup": lambda s, d: simhash.near_duplicate_query(table(s, d, "documents")),
        "op6_document_fingerprints": lambda s, d: fingerprints.fingerprint_query(table(s, d, "documents")),
        "op7_byte_bpe": lambda s, d: bpe.bpe_query(table(s, d, "documents")),
        "op8_quality_classifier": lambda s, d: quality.quality_query(table(s, d, "documents"), table(s, d, "labels")),
        "op9_lm_scoring": lambda s, d: lattice.score_texts(table(s, d, "documents")),
        "op10_chat_formatting": lambda s, d: chat.chat_query(table(s, d, "conversations")),
        "op11_source_divergence": lambda s, d: divergence.source_divergence(table(s, d, "documents")),
        "op12_centroid_clustering": lambda s, d: centroids.clustered(table(s, d, "embeddings")),
        "op13_token_files": lambda s, d: grammar.token_files(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_topk": topk.TOPK_SQL, "op10_chat_formatting": chat.CHAT_SQL, "op11_source_divergence": divergence.DIVERGENCE_SQL, "op12_centroid_clustering": centroids.CLUSTER_SQL}
