"""Queries of the text operators, and SQL where it can express them."""

from __future__ import annotations

from causeway.llm import arc_to_warc, chat_format, decontaminate, language_model, line_dedup, packing, simhash, syncmers, token_count, toxicity


def queries():
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_language_model": language_model.op2_language_model,
        "op3_simhash": simhash.op3_simhash,
        "op4_line_dedup": line_dedup.op4_line_dedup,
        "op5_decontamination": decontaminate.op5_decontamination,
        "op6_token_count": token_count.op6_token_count,
        "op7_fingerprints": syncmers.op7_fingerprints,
        "op8_warc": arc_to_warc.op8_warc,
        "op9_best_fit_packing": packing.op9_best_fit_packing,
        "op10_chat_format": chat_format.op10_chat_format,
    }


def oracle_sql():
    return {
        "op4_line_dedup": line_dedup.SQL_OP4,
        "op5_decontamination": decontaminate.SQL_OP5,
        "op8_warc": arc_to_warc.SQL_OP8,
        "op10_chat_format": chat_format.SQL_OP10,
    }
