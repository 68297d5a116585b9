"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from . import ann, bpe, fingerprint, katz, langid, licenses, mixing, neardup, passages, surrogates


def queries() -> dict:
    return {
        "op1_repeated_passages": passages.op1_repeated_passages,
        "op2_source_mixing": mixing.op2_source_mixing,
        "op3_minhash_near_dedup": neardup.op3_minhash_near_dedup,
        "op4_license_scan": licenses.op4_license_scan,
        "op5_nearest_neighbours": ann.op5_nearest_neighbours,
        "op6_document_fingerprints": fingerprint.op6_document_fingerprints,
        "op7_bpe_encode_decode": bpe.op7_bpe_encode_decode,
        "op8_pii_surrogates": surrogates.op8_pii_surrogates,
        "op9_language_id": langid.op9_language_id,
        "op10_katz_scoring": katz.op10_katz_scoring,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_minhash_near_dedup": neardup.sql(), "op4_license_scan": licenses.sql()}
