"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from tidewater.llm import chat_tree, decontam, fingerprint, kmeans, langid, line_dedup, minhash, mixing, pii, pu_quality, spelling, toxicity, url_filter

QUERIES = {
    "op1_line_dedup": line_dedup.op1,
    "op2_fingerprint": fingerprint.op2,
    "op3_langid": langid.op3,
    "op4_url_filter": url_filter.op4,
    "op5_pii": pii.op5,
    "op6_decontam": decontam.op6,
    "op7_minhash": minhash.op7,
    "op8_mixing": mixing.op8,
    "op9_quality": pu_quality.op9,
    "op10_toxicity": toxicity.op10,
    "op11_kmeans": kmeans.op11,
    "op12_chat_tree": chat_tree.op12,
    "op13_spelling": spelling.op13,
}
ORACLE = {
    "op1_line_dedup": line_dedup.OP1_SQL,
    "op4_url_filter": url_filter.OP4_SQL,
    "op7_minhash": minhash.OP7_SQL,
    "op8_mixing": mixing.OP8_SQL,
    "op11_kmeans": kmeans.OP11_SQL,
    "op12_chat_tree": chat_tree.OP12_SQL,
}
