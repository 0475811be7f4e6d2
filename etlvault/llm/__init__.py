"""Operators for preparing language-model training data, and their registered queries."""

from __future__ import annotations

import importlib

_MODULES = ("decontaminate", "exact_dedup", "html_text", "hilbert_shards", "jaccard_join", "langid", "line_dedup", "piece_transducer", "prefix_trie", "toxicity", "turn_repair", "url_rules", "warc")


def _merged(attribute: str) -> dict:
    return {k: v for name in _MODULES for k, v in getattr(importlib.import_module(f"etlvault.llm.{name}"), attribute).items()}


def all_queries() -> dict:
    return _merged("QUERIES")


def all_oracles() -> dict:
    return _merged("ORACLE")
