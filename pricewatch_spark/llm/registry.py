"""The queries of this subpackage, one for each operator."""

from __future__ import annotations

import importlib

MODULES = (
    "chat_format",
    "class_lm",
    "quality",
    "decontaminate",
    "toxicity",
    "media",
    "mixing",
    "near_dedup",
    "substring_dedup",
    "suffix_dedup",
    "fingerprints",
    "spelling",
    "vector_codes",
)

QUERIES: dict = {}
ORACLES: dict = {}

for _name in MODULES:
    _module = importlib.import_module(f"pricewatch_spark.llm.{_name}")
    QUERIES[_module.NAME] = _module.query
    if _module.ORACLE_SQL:
        ORACLES[_module.NAME] = _module.ORACLE_SQL
