"""The registered queries and, where SQL can express them, the same query in SQL."""

from __future__ import annotations

import importlib

_MODULES = ("vault_queries", "recon_queries", "quality_queries", "profile_queries", "pii_queries",
            "catalog_queries", "scan_queries", "lineage_queries", "feature_queries", "stream_queries",
            "store_queries")


def _merged(attribute: str) -> dict:
    out: dict = {}
    for name in _MODULES:
        module = importlib.import_module(f"etlvault.workload.{name}")
        for key, value in getattr(module, attribute).items():
            if key in out:
                raise KeyError(f"query registered twice: {key}")
            out[key] = value
    return out


def all_queries() -> dict:
    return _merged("QUERIES")


def all_oracles() -> dict:
    return _merged("ORACLE")
