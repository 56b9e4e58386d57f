"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from . import chat_format, decontaminate, embed_dedup, license_scan, line_dedup, packing, quality, simhash, suffix_dedup, token_files


def queries() -> dict:
    return {
        "op1_embedding_dedup": embed_dedup.op1_embedding_dedup,
        "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
        "op2_line_dedup": line_dedup.op2_line_dedup,
        "op3_chat_formatting": chat_format.op3_chat_formatting,
        "op4_packing": packing.op4_packing,
        "op5_simhash": simhash.op5_simhash,
        "op6_token_files": token_files.op6_token_files,
        "op7_quality": quality.op7_quality,
        "op8_license_scan": license_scan.op8_license_scan,
        "op9_decontamination": decontaminate.op9_decontamination,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": line_dedup.ORACLE,
        "op3_chat_formatting": chat_format.ORACLE,
        "op8_license_scan": license_scan.ORACLE,
        "op9_decontamination": decontaminate.ORACLE,
    }
