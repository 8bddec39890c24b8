"""The queries of this subpackage, by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import ann, bpe, conversation_repair, fingerprint, html_extract, importance, jaccard_join, language_id, mixing, quality, secret_scan, token_counts, token_files

QUERIES = {
    "op1_secret_scan": secret_scan.query,
    "op2_quality_classifier": quality.query,
    "op3_source_mixing": mixing.query,
    "op4_nearest_neighbours": ann.query,
    "op5_document_fingerprints": fingerprint.query,
    "op6_token_counts": token_counts.query,
    "op7_byte_bpe": bpe.query,
    "op8_jaccard_join": jaccard_join.query,
    "op9_language_id": language_id.query,
    "op10_html_extraction": html_extract.query,
    "op11_conversation_repair": conversation_repair.query,
    "op12_token_files": token_files.query,
    "op13_importance_resampling": importance.query,
}
ORACLES: dict[str, str] = {
    "op1_secret_scan": secret_scan.ORACLE_SQL,
    "op3_source_mixing": mixing.ORACLE_SQL,
    "op6_token_counts": token_counts.ORACLE_SQL,
}
