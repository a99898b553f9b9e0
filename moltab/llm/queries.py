"""Registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

import corpus_pipeline
from moltab.llm import (op1_packing, op2_covertree, op3_token_counts, op4_mixing,
                        op5_language_id, op6_topk, op7_sharding, op8_secret_scan, op9_minhash,
                        op10_license_scan, op11_hard_negatives,
                        op12_conversation_trie, op13_line_rules)

QUERIES = {
    "op1_packing": op1_packing.query,
    "op2_covertree": op2_covertree.query,
    "op3_token_counts": op3_token_counts.query,
    "op4_mixing": op4_mixing.query,
    "op5_language_id": op5_language_id.query,
    "op6_topk": op6_topk.query,
    "op7_sharding": op7_sharding.query,
    "op8_secret_scan": op8_secret_scan.query,
    "op9_minhash": op9_minhash.query,
    "op10_license_scan": op10_license_scan.query,
    "op11_hard_negatives": op11_hard_negatives.query,
    "op12_conversation_trie": op12_conversation_trie.query,
    "op13_line_rules": op13_line_rules.query,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op2_covertree": op2_covertree.ORACLE,
    "op6_topk": op6_topk.ORACLE,
    "op7_sharding": op7_sharding.ORACLE,
    "op11_hard_negatives": op11_hard_negatives.ORACLE,
    "op12_conversation_trie": op12_conversation_trie.ORACLE,
    "op13_line_rules": op13_line_rules.ORACLE,
}
