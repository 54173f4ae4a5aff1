"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from linkbook.llm import chat_format, decontamination, jaccard_join, license_scan, line_dedup, lm_scoring, mixing
from linkbook.llm import prefix_trie, quality, secret_scan, structure_repair, substring_dedup, toxicity

_MODULES = {
    "op1_mixing": mixing,
    "op2_chat_format": chat_format,
    "op3_line_dedup": line_dedup,
    "op4_decontamination": decontamination,
    "op5_lm_scoring": lm_scoring,
    "op6_substring_dedup": substring_dedup,
    "op7_toxicity": toxicity,
    "op8_jaccard_join": jaccard_join,
    "op9_quality": quality,
    "op10_license_scan": license_scan,
    "op11_structure_repair": structure_repair,
    "op12_prefix_trie": prefix_trie,
    "op13_secret_scan": secret_scan,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: module.query for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    """The statements of the queries that SQL can express."""
    return {name: module.SQL for name, module in _MODULES.items() if hasattr(module, "SQL")}
