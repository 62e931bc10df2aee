"""All queries of the subpackage."""

from __future__ import annotations

from cartlens.llm import op10_mixing, op11_vafile, op12_packing, op13_whitening, op1_topk, op2_pii, op3_minhash, op4_suffix_tree, op5_warc, op6_quality, op7_bpe, op8_substrings, op9_toxicity, registry

_MODULES = (op1_topk, op2_pii, op3_minhash, op4_suffix_tree, op5_warc, op6_quality, op7_bpe, op8_substrings, op9_toxicity, op10_mixing, op11_vafile, op12_packing, op13_whitening)


def queries():
    return dict(registry.QUERIES)


def oracle_sql():
    return dict(registry.ORACLES)
