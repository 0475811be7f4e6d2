"""Reading input tables in the formats the jobs accept."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, form: str | None = None, schema: str | None = None,
               options: Mapping[str, str] | None = None) -> DataFrame:
    """A table from parquet, orc, json, csv or tsv, by extension unless ``form`` names it.

    Delimited text without a schema comes as strings: coercing a column later costs
    nothing, inferring types would read the data twice.
    """
    form = form or path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read.options(**dict(options or {}))
    if schema:
        reader = reader.schema(schema)
    if form in ("csv", "tsv", "txt"):
        reader = reader.option("header", True)
        if form == "tsv":
            reader = reader.option("sep", "\t")
        return reader.csv(path)
    return reader.format(form).load(path)


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None, lower: int = 0, upper: int = 0,
              partitions: int = 1, properties: Mapping[str, str] | None = None) -> DataFrame:
    """A database table or query, read in parallel ranges when a numeric partition column is given."""
    options = dict(properties or {})
    if partition_column is None:
        return spark.read.jdbc(url, table, properties=options)
    return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower, upperBound=upper, numPartitions=partitions, properties=options)
