"""Queries of the training-data operators and their SQL, where SQL can express them."""

from __future__ import annotations

from timelens.llm import bpe, chat_template, decontaminate, importance_resampling, jaccard_join, kd_shards, language_id, minhash_dedup, nn_search, pii, prefix_trie, quality, url_filter

QUERIES = {
    "op1_url_filter": url_filter.query,
    "op2_bpe": bpe.query,
    "op3_pii": pii.query,
    "op4_language_id": language_id.query,
    "op5_nn_search": nn_search.query,
    "op6_decontaminate": decontaminate.query,
    "op7_kd_shards": kd_shards.query,
    "op8_quality": quality.query,
    "op9_chat_format": chat_template.query,
    "op10_jaccard_join": jaccard_join.query,
    "op11_importance_resampling": importance_resampling.query,
    "op12_prefix_trie": prefix_trie.query,
    "op13_minhash_dedup": minhash_dedup.query,
}

ORACLE_SQL = {
    "op1_url_filter": url_filter.SQL,
    "op9_chat_format": chat_template.SQL,
    "op10_jaccard_join": jaccard_join.SQL,
    "op11_importance_resampling": importance_resampling.SQL,
    "op12_prefix_trie": prefix_trie.SQL,
    "op13_minhash_dedup": minhash_dedup.SQL,
}
