"""Registered queries of the training-data operators and their SQL (where SQL can express them)."""

from __future__ import annotations

from cairnbook.llm import ans, brown, fingerprints, jaccard, kdtree, langid, manifest, mixing, packing, secrets, toxicity, warc, wavelet

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_topk_search": kdtree.op2_topk_search,
    "op3_warc_audit": warc.op3_warc_audit,
    "op4_fingerprints": fingerprints.op4_fingerprints,
    "op5_mixing": mixing.op5_mixing,
    "op6_packing": packing.op6_packing,
    "op7_token_ids": ans.op7_token_ids,
    "op8_jaccard_join": jaccard.op8_jaccard_join,
    "op9_language_id": langid.op9_language_id,
    "op10_language_model": brown.op10_language_model,
    "op11_manifest": manifest.op11_manifest,
    "op12_ranked_search": wavelet.op12_ranked_search,
    "op13_secrets": secrets.op13_secrets,
}

SQL: dict[str, str] = {
    "op2_topk_search": kdtree.OP2_SQL,
    "op3_warc_audit": warc.OP3_SQL,
    "op5_mixing": mixing.OP5_SQL,
    "op8_jaccard_join": jaccard.OP8_SQL,
    "op11_manifest": manifest.OP11_SQL,
    "op12_ranked_search": wavelet.OP12_SQL,
}
