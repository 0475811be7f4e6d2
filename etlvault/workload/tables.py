"""Reading the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from etlvault.session import configure, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def wide(spark: SparkSession, sf_dir: str, name: str, *columns: str, task_rows: int | None = None) -> DataFrame:
    """A table for costly per-row work, given columns only, spread over the cores."""
    scan = table(spark, sf_dir, name)
    return spread(scan.select(*columns) if columns else scan, task_rows)
