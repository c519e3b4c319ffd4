"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from routelens.llm import (
    filter_audit, hnsw, language_id, order_minhash, pii_crf, prefix_trie, quality_gam, range_shards, risk_rules, source_mix, token_counts, toxicity_crf, winnow,
)

QUERIES: dict[str, Callable] = {
    "op1_quality_gam": quality_gam.op1_quality_gam,
    "op2_hnsw_nearest": hnsw.op2_hnsw_nearest,
    "op3_order_minhash_near_dedup": order_minhash.op3_order_minhash_near_dedup,
    "op4_source_mix": source_mix.op4_source_mix,
    "op5_language_id": language_id.op5_language_id,
    "op6_range_shards": range_shards.op6_range_shards,
    "op7_pii_crf": pii_crf.op7_pii_crf,
    "op8_toxicity_crf": toxicity_crf.op8_toxicity_crf,
    "op9_winnow_decontamination": winnow.op9_winnow_decontamination,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_risk_rules": risk_rules.op12_risk_rules,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

ORACLES: dict[str, str] = {
    "op4_source_mix": source_mix.OP4_SQL,
    "op9_winnow_decontamination": winnow.OP9_SQL,
    "op11_filter_audit": filter_audit.OP11_SQL,
    "op12_risk_rules": risk_rules.OP12_SQL,
    "op13_prefix_trie": prefix_trie.OP13_SQL,
}
