"""Registered queries of this subpackage, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from tidemark.llm import bpe_codec, chat_format, decontaminate, embedding_dedup, fill_middle, fingerprints, language_id, near_dedup, rolling_windows, token_count, toxicity, url_filter, warc

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op4_chat_format": chat_format.op4_chat_format,
    "op5_bpe_codec": bpe_codec.op5_bpe_codec,
    "op6_language_id": language_id.op6_language_id,
    "op7_warc": warc.op7_warc,
    "op8_token_counts": token_count.op8_token_counts,
    "op9_embedding_dedup": embedding_dedup.op9_embedding_dedup,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_rolling_windows": rolling_windows.op11_rolling_windows,
    "op12_fill_middle": fill_middle.op12_fill_middle,
    "op13_fingerprints": fingerprints.op13_fingerprints,
    "warc_of_copies": warc.warc_of_copies,
}

ORACLES = {
    "op2_decontamination": decontaminate.ORACLE,
    "op3_near_dedup": near_dedup.ORACLE,
    "op4_chat_format": chat_format.ORACLE,
    "op7_warc": warc.ORACLE,
    "op9_embedding_dedup": embedding_dedup.ORACLE,
    "op10_url_filter": url_filter.ORACLE,
    "op11_rolling_windows": rolling_windows.ORACLE,
    "op12_fill_middle": fill_middle.ORACLE,
    "warc_of_copies": warc.ORACLE_COPIES,
}
