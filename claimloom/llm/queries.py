"""The subpackage's queries and the SQL that some can be held against."""

from __future__ import annotations

from claimloom.llm import (
    byte_bpe,
    chat_format,
    decontaminate,
    hilbert_packing,
    html_extract,
    importance_resampling,
    language_id,
    quality_knn,
    rabitq_dedup,
    secret_scan,
    simhash_vptree,
    source_divergence,
    warc_zstd,
)

QUERIES = {
    "op1_secret_scan": secret_scan.op1_secret_scan,
    "op2_quality_knn": quality_knn.op2_quality_knn,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_chat_format": chat_format.op4_chat_format,
    "op5_rabitq_dedup": rabitq_dedup.op5_rabitq_dedup,
    "op6_hilbert_packing": hilbert_packing.op6_hilbert_packing,
    "op7_html_extract": html_extract.op7_html_extract,
    "op8_warc_zstd": warc_zstd.op8_warc_zstd,
    "op9_language_id": language_id.op9_language_id,
    "op10_simhash_vptree": simhash_vptree.op10_simhash_vptree,
    "op11_source_divergence": source_divergence.op11_source_divergence,
    "op12_importance_resampling": importance_resampling.op12_importance_resampling,
    "op13_byte_bpe": byte_bpe.op13_byte_bpe,
}

ORACLES = {
    "op3_decontaminate": decontaminate.ORACLE_SQL,
    "op4_chat_format": chat_format.ORACLE_SQL,
    "op5_rabitq_dedup": rabitq_dedup.ORACLE_SQL,
    "op8_warc_zstd": warc_zstd.ORACLE_SQL,
    "op11_source_divergence": source_divergence.ORACLE_SQL,
    "op12_importance_resampling": importance_resampling.ORACLE_SQL,
}
