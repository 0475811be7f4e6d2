"""History tables, report sinks and metadata files."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from etlvault.functions.columns import col

RUN_KEYS = ("dataset_name", "run_timestamp")


def append_history(df: DataFrame, target: str, catalog: bool = False) -> bool:
    """Append one run's rows, partitioned by data set; an empty run writes nothing.

    ``target`` is a path, or a table name with ``catalog``.
    """
    if df.isEmpty():
        return False
    writer = df.write.mode("append").partitionBy("dataset_name")
    writer.saveAsTable(target) if catalog else writer.parquet(target)
    return True


def append_history_jdbc(df: DataFrame, url: str, table: str, properties: Mapping[str, str] | None = None) -> bool:
    """The same into a database table."""
    if df.isEmpty():
        return False
    df.write.jdbc(url, table, mode="append", properties=dict(properties or {}))
    return True


def read_history(spark: SparkSession, source: str, dataset: str | None = None, catalog: bool = False) -> DataFrame:
    """Rows of all runs, or of one data set; the filter prunes partitions."""
    rows = spark.read.table(source) if catalog else spark.read.parquet(source)
    return rows if dataset is None else rows.filter(F.col("dataset_name") == dataset)


def latest_run(history: DataFrame) -> DataFrame:
    """The rows of each data set's last run."""
    last = history.groupBy("dataset_name").agg(F.max("run_timestamp").alias("run_timestamp"))
    # one row per data set; the join side stays the aggregate
    return history.join(last, list(RUN_KEYS), "left_semi")


def latest_rows(history: DataFrame, n: int) -> DataFrame:
    """The newest n rows for a look at the table."""
    return history.orderBy(F.desc("run_timestamp"), *[col(c) for c in history.columns if c != "run_timestamp"]).limit(n)


def latest_key(registry: DataFrame, dataset: str) -> DataFrame:
    """Key id of the data set's last run."""
    return registry.filter(F.col("dataset_name") == dataset).agg(F.max_by("key_id", "run_timestamp").alias("key_id"))


def report_tables(summary: DataFrame, rows: DataFrame, subsets: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The parts of a report: its summary, all rows and named subsets."""
    return {"summary": summary, "all": rows, **subsets}


def write_report(tables: Mapping[str, DataFrame], path: str, form: str = "json") -> None:
    """One folder per part, as json, csv or parquet."""
    for name, df in tables.items():
        df.write.mode("overwrite").format(form).options(**({"header": "true"} if form == "csv" else {})).save(f"{path}/{name}")


# Column names of the one metadata dialect and of the other.
RENAMES = {
    "column": {"name": "column_name", "type": "data_type", "pk": "is_pk"},
    "mapping": {"src_table": "source_table", "src_col": "source_column", "tgt_table": "target_table", "tgt_col": "target_column"},
}


def to_common(df: DataFrame, kind: str) -> DataFrame:
    """Columns of either dialect under the common names; a column present in both keeps its first non-null value."""
    for old, new in RENAMES[kind].items():
        if old in df.columns and new in df.columns:
            df = df.withColumn(new, F.coalesce(col(new), col(old))).drop(old)
        elif old in df.columns:
            df = df.withColumnRenamed(old, new)
    return df


def write_metadata(catalogs: Mapping[str, DataFrame], path: str) -> None:
    for name, df in catalogs.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def read_metadata(spark: SparkSession, path: str, schemas: Mapping[str, str]) -> dict[str, DataFrame]:
    """Catalogs written before, under their schemas, so that empty fields keep their types."""
    return {name: spark.read.schema(schema).json(f"{path}/{name}") for name, schema in schemas.items()}
