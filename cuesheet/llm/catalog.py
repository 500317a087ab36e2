"""Queries of the package and their SQL twins."""

from __future__ import annotations

import importlib

_MODULES = ("exact_dedup", "chat_format", "packing", "toxicity", "decontaminate", "minhash", "line_dedup", "pii", "ppm", "repeats", "token_counts", "merkle", "collocations")

QUERIES: dict = {}
ORACLE: dict = {}
for _name in _MODULES:
    _module = importlib.import_module(f"cuesheet.llm.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLE.update(getattr(_module, "ORACLE", {}))
