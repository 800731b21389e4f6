"""Queries of this subpackage and their SQL, for the repository's entry module."""

from __future__ import annotations

from . import divergence, embeddings, licenses, minhash, mixing, packing, passages, privacy, quality, suffixes, token_counts, urls, variants

QUERIES = {
    "op1_pii": privacy.op1_pii,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_passages": passages.op3_passages,
    "op4_embeddings": embeddings.op4_embeddings,
    "op5_packing": packing.op5_packing,
    "op6_minhash": minhash.op6_minhash,
    "op7_quality": quality.op7_quality,
    "op8_urls": urls.op8_urls,
    "op9_suffix_array": suffixes.op9_suffix_array,
    "op10_mixing": mixing.op10_mixing,
    "op11_divergence": divergence.op11_divergence,
    "op12_licenses": licenses.op12_licenses,
    "op13_variants": variants.op13_variants,
}

ORACLE_SQL = {
    "op4_embeddings": embeddings.OP4_SQL,
    "op7_quality": quality.OP7_SQL,
    "op10_mixing": mixing.OP10_SQL,
    "op11_divergence": divergence.OP11_SQL,
    "op12_licenses": licenses.OP12_SQL,
    "op13_variants": variants.OP13_SQL,
}
