"""Governed warehouse loading on Spark: mapping, Data Vault loads, reconciliation, quality, profiling and PII jobs."""

__version__ = "0.1.0"
