"""Evaluation of data-quality rules.

All scalar rules of a table run in one aggregate over one scan; each uniqueness or
reference rule adds one aggregate over its own column only.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from etlvault.functions.columns import col, resolve

Rule = Mapping[str, Any]

# The six dimensions and what they assert, the email pattern and the earliest date.
DIMENSIONS = {
    "COMPLETENESS": "No unexpected NULLs in required fields",
    "UNIQUENESS": "No duplicate values in key columns",
    "VALIDITY": "Values conform to defined formats and ranges",
    "CONSISTENCY": "Referential integrity and cross-column consistency",
    "TIMELINESS": "Date/timestamp values are within expected ranges",
    "ACCURACY": "Numeric values within expected statistical bounds",
}
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$"
MIN_DATE = "1900-01-01"


def dimensions(spark) -> DataFrame:
    return spark.createDataFrame(list(DIMENSIONS.items()), "dimension string, description string")


def _timestamp(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return column.cast("timestamp_ntz")
    return column.cast("string").try_cast("timestamp_ntz")


def _number(column: Column, kind: T.DataType) -> Column:
    return column if isinstance(kind, T.NumericType) else column.cast("string").try_cast("double")


def failure(df: DataFrame, name: str, rule: Rule) -> Column | None:
    """Boolean expression, true on rows that break a scalar rule; None for other rule types."""
    column, kind, check = col(name), df.schema[name].dataType, rule["check_type"]
    tests: list[Column] = []
    if check == "NOT_NULL":
        tests = [column.isNull()]
    elif check == "REGEX":
        re.compile(rule["pattern"])
        tests = [~F.regexp_like(column.cast("string"), F.lit(f"^(?:{rule['pattern']})"))]
    elif check == "RANGE":
        value = _number(column, kind)
        if rule.get("min_value") is not None:
            tests.append(value < F.lit(rule["min_value"]))
        if rule.get("max_value") is not None:
            tests.append(value > F.lit(rule["max_value"]))
    elif check == "DATE_RANGE":
        value = _timestamp(column, kind)
        for bound, wrong in (("min_date", value.__lt__), ("max_date", value.__gt__)):
            if rule.get(bound) is not None:
                tests.append(wrong(F.lit(rule[bound]).cast("timestamp_ntz")))
    elif check in ("NO_FUTURE_DATES", "LOAD_DATE_CURRENT"):
        tests = [_timestamp(column, kind) > F.lit(rule["as_of"]).cast("timestamp_ntz")]
    elif check == "ACCEPTED_VALUES" and "ref_table" in rule:
        return None  # judged by a join, see evaluate
    elif check == "ACCEPTED_VALUES":
        tests = [~column.cast("string").isin(list(rule["values"]))]
    elif check == "DATE_FORMAT":
        parsed = F.try_to_timestamp(column.cast("string"), F.lit(rule["format"]))
        tests = [column.isNotNull() & parsed.isNull()]
    elif check == "STRING_LENGTH":
        tests = [F.length(column.cast("string")) > F.lit(rule["max_length"])]
    else:
        return None
    return F.coalesce(reduce(Column.__or__, tests), F.lit(False)) if tests else F.lit(False)


def _unique(df: DataFrame, name: str) -> DataFrame:
    """Rows minus distinct non-null values, from the value counts of that column alone."""
    counted = df.groupBy(col(name)).agg(F.count("*").alias("n"))
    rows = F.coalesce(F.sum("n"), F.lit(0))
    return counted.agg(rows.alias("rows_checked"), (rows - F.count(col(name))).alias("actual_failures"))


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Non-null child keys without a parent, with their row counts.

    Child rows are counted per key before they meet the parent keys, so a key holding
    most of the child table is one row by then.
    """
    kids = child.select(col(key).cast("string").alias("key"), F.lit(1).alias("n"), F.lit(0).alias("p"))
    folks = parent.select(col(parent_key).cast("string").alias("key"), F.lit(0).alias("n"), F.lit(1).alias("p"))
    return (kids.union(folks).filter(F.col("key").isNotNull()).groupBy("key")
            .agg(F.sum("n").alias("child_rows"), F.max("p").alias("in_parent"))
            .filter("in_parent = 0 AND child_rows > 0").select("key", "child_rows"))


def _referential(df: DataFrame, name: str, rule: Rule, parents: Mapping[str, DataFrame]) -> DataFrame:
    lost = orphans(df, name, parents[rule["ref_table"]], rule["ref_column"])
    rows = df.agg(F.count("*").alias("n")).scalar()
    return lost.agg(F.coalesce(F.sum("child_rows"), F.lit(0)).alias("actual_failures")).select(
        rows.alias("rows_checked"), "actual_failures")


def evaluate(df: DataFrame, rules: Sequence[Rule], table: str | None = None,
             parents: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """One result row per rule: failures, rows checked, pass rate and status.

    ACCEPTED_VALUES takes a short list in ``values``, or any number of values from the column
    ``ref_column`` of the table ``ref_table`` in ``parents``, by a join like a reference.
    A rule on an absent column, or needing a parent table not given, is SKIPPED; one that
    is itself wrong (no or bad pattern, missing bound) is an ERROR with pass rate 0.
    """
    spark, parents = df.sparkSession, parents or {}
    scalar: list[Column] = []
    results: list[DataFrame] = []
    heads: list[tuple] = []
    for i, rule in enumerate(rules):
        name, note, status = resolve(df, rule["column"]), None, None
        check = rule["check_type"]
        try:
            test = failure(df, name, rule) if name else None
        except (KeyError, TypeError, re.error) as problem:
            test, status, note = None, "ERROR", f"{type(problem).__name__}: {problem}"
        if status == "ERROR":
            pass
        elif name is None:
            status, note = "SKIPPED", f"Column '{rule['column']}' is not in the table"
        elif check == "UNIQUE":
            results.append(_unique(df, name).withColumn("i", F.lit(i)))
        elif check in ("REFERENTIAL_INTEGRITY", "ACCEPTED_VALUES") and rule.get("ref_table") in parents:
            results.append(_referential(df, name, rule, parents).withColumn("i", F.lit(i)))
        elif test is None:
            status, note = "SKIPPED", f"Check type {check} needs a table that was not given"
        else:
            scalar.append(F.struct(F.lit(i).alias("i"), F.count_if(test).alias("actual_failures")))
        heads.append((i, rule.get("rule_id"), rule.get("dimension"), rule.get("table") or table, rule["column"],
                      check, int(rule.get("threshold") or 0), status, note))
    if scalar:
        fused = df.agg(F.count("*").alias("rows_checked"), F.array(*scalar).alias("r"))
        results.append(fused.select("rows_checked", F.inline("r")).select("rows_checked", "actual_failures", "i"))
    head = spark.createDataFrame(
        heads, "i int, rule_id string, dimension string, `table` string, `column` string, check_type string, "
               "threshold bigint, preset string, note string")
    if results:
        measured = reduce(DataFrame.unionByName, results)
    else:
        measured = spark.createDataFrame([], "rows_checked bigint, actual_failures bigint, i int")
    # one row per rule on both sides of this join
    n, f = F.col("rows_checked"), F.col("actual_failures")
    return head.join(measured, "i", "left").select(
        "rule_id", "dimension", "table", "column", "check_type", "threshold",
        F.coalesce(n, F.lit(0)).alias("rows_checked"), F.coalesce(f, F.lit(0)).alias("actual_failures"),
        F.when(F.col("preset") == "ERROR", F.lit(0.0))
        .when(n > 0, F.round((n - f) * F.lit(100.0) / n, 2)).otherwise(F.lit(100.0)).alias("pass_rate"),
        F.coalesce("preset", F.when(f <= F.col("threshold"), "PASS").otherwise("FAIL")).alias("status"), "note")


def by_dimension(results: DataFrame) -> DataFrame:
    return results.groupBy("dimension", "status").agg(F.count("*").alias("rules"))


def summarise(results: DataFrame) -> DataFrame:
    """Totals by status and the overall pass percentage over evaluated rules."""
    passed, failed = F.count_if(F.col("status") == "PASS"), F.count_if(F.col("status") == "FAIL")
    return results.agg(
        F.count("*").alias("total_rules"), passed.alias("passed"), failed.alias("failed"),
        F.count_if(F.col("status") == "SKIPPED").alias("skipped"), F.count_if(F.col("status") == "ERROR").alias("errored"),
        F.round(passed * F.lit(100.0) / F.greatest(passed + failed, F.lit(1)), 2).alias("overall_pass_pct"))


def failed(results: DataFrame) -> DataFrame:
    return results.filter(F.col("status") == "FAIL")
