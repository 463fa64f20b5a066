"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import audit, bpe, chat, embeddings, fingerprints, lines, lloyd, minhash, packing, pii, prefix, quality, urls

QUERIES = {
    f.__name__: f
    for f in (
        packing.op1_best_fit_packing, urls.op2_url_filter, fingerprints.op3_document_fingerprints, minhash.op4_minhash_dedup, chat.op5_chat_formatting,
        lines.op6_line_dedup, bpe.op7_bpe_tokens, embeddings.op8_embedding_dedup, pii.op9_pii, quality.op10_quality_classifier, audit.op11_filter_audit, prefix.op12_token_counts,
        lloyd.op13_vector_codes,
    )
}
ORACLE_SQL = {**urls.ORACLE, **audit.ORACLE, **lloyd.ORACLE}
