"""The queries of this subpackage, as __spark_entry__.py adds them."""

from __future__ import annotations

import importlib

MODULES = ["ngram_join", "pii", "mixing", "exact_dedup", "quality", "langid", "chat", "secrets_scan", "line_dedup", "bpe"]

QUERIES: dict = {}
ORACLES: dict = {}
for _name in MODULES:
    _m = importlib.import_module(f"genloom.llm.{_name}")
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
