"""The registered queries of the text operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, chat, contamination, html_text, merkle, mixing, personal, quality, repair, simhash, substrings, toxicity, url_filter

MODULES = {
    "op1_mix_sources": mixing,
    "op2_simhash_groups": simhash,
    "op3_quality_classifier": quality,
    "op4_chat_format": chat,
    "op5_html_text": html_text,
    "op6_url_filter": url_filter,
    "op7_substring_dedup": substrings,
    "op8_nearest_neighbours": ann,
    "op9_decontamination": contamination,
    "op10_toxicity": toxicity,
    "op11_merkle_manifest": merkle,
    "op12_conversation_repair": repair,
    "op13_personal_data": personal,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: module.query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE_SQL for name, module in MODULES.items() if hasattr(module, "ORACLE_SQL")}
