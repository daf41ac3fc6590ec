"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import align, chat, chunks, decontaminate, language, licenses, lines, packing, pii, quality, repair, simhash, urls

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_url_filter": urls.op2_url_filter,
    "op2_url_filter_whole": urls.op2_url_filter,
    "op3_chat_format": chat.op3_chat_format,
    "op4_line_dedup": lines.op4_line_dedup,
    "op5_language_id": language.op5_language_id,
    "op6_benchmark_passages": decontaminate.op6_benchmark_passages,
    "op7_personal_data": pii.op7_personal_data,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_simhash_near_dedup": simhash.op9_simhash_near_dedup,
    "op10_document_fingerprints": chunks.op10_document_fingerprints,
    "op11_token_alignment": align.op11_token_alignment,
    "op12_conversation_repair": repair.op12_conversation_repair,
    "op13_quality_rules": quality.op13_quality_rules,
}

ORACLES: dict[str, str] = {
    "op2_url_filter": urls.OP2_SQL,
    "op2_url_filter_whole": urls.OP2_SQL,
    "op3_chat_format": chat.OP3_SQL,
    "op4_line_dedup": lines.OP4_SQL,
    "op12_conversation_repair": repair.OP12_SQL,
    "op13_quality_rules": quality.OP13_SQL,
}
