"""Rules derived from metadata: catalogs, mapping table and vault model."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from etlvault.functions.columns import cols
from etlvault.operators.ordered import with_running_number
from etlvault.operators.quality import EMAIL_PATTERN, MIN_DATE

# Name parts that mark an amount column.
AMOUNT_WORDS = ["amount", "revenue", "price", "salary", "cost"]
AMOUNT_NAMES = ["AMOUNT", "PRICE", "SALARY", "COST"]

RULE_FIELDS = {
    "section": "int", "prefix": "string", "dimension": "string", "table": "string", "column": "string",
    "ordinal": "int", "rule": "string", "check_type": "string", "threshold": "bigint", "pattern": "string",
    "min_value": "double", "min_date": "string", "max_date": "string", "ref_table": "string", "ref_column": "string",
}


def _rule(df: DataFrame, **values: Column | str | int | float) -> DataFrame:
    made = []
    for name, kind in RULE_FIELDS.items():
        v = values.get(name)
        made.append((v if isinstance(v, Column) else F.lit(v)).cast(kind).alias(name))
    return df.select(*made)


def _contains_any(column: Column, words: Sequence[str]) -> Column:
    return reduce(Column.__or__, [column.contains(w) for w in words])


def generate_rules(catalog: DataFrame, hubs: DataFrame | None = None, links: DataFrame | None = None,
                   sttm: DataFrame | None = None, as_of: str = "2024-01-01", numbered: bool = True) -> DataFrame:
    """Rules of all six kinds, numbered DQ_<kind>_<n> in section, table and column order.

    ``numbered=False`` leaves ``rule_id`` NULL, which spares the sort of all rules and its jobs.
    ``as_of`` stands for today, so that a rerun gives the same rules.
    """
    t, c, q = F.col("table_name"), F.col("column_name"), F.lit("'")
    lower, kind = F.lower("column_name"), F.upper("data_type")
    src = catalog.filter(F.col("role") == "source")
    quoted = F.concat(q, c, q)
    parts = [
        _rule(src.filter(~F.col("nullable")), section=1, prefix="COMP", dimension="COMPLETENESS", table=t, column=c,
              ordinal=F.col("ordinal"), check_type="NOT_NULL", threshold=0,
              rule=F.concat(F.lit("Column "), quoted, F.lit(" must not be NULL"))),
        _rule(src.filter(lower.contains("email")), section=3, prefix="VALD", dimension="VALIDITY", table=t, column=c,
              ordinal=F.col("ordinal"), check_type="REGEX", threshold=0, pattern=EMAIL_PATTERN,
              rule=F.concat(quoted, F.lit(" must match email format"))),
        _rule(src.filter(kind.contains("DATE") | kind.contains("TIMESTAMP") | lower.contains("date")),
              section=3, prefix="VALD", dimension="TIMELINESS", table=t, column=c, ordinal=F.col("ordinal"),
              check_type="DATE_RANGE", threshold=0, min_date=MIN_DATE, max_date=as_of,
              rule=F.concat(quoted, F.lit(f" must be between {MIN_DATE} and today"))),
        _rule(src.filter(_contains_any(lower, AMOUNT_WORDS) & kind.contains("DECIMAL")),
              section=3, prefix="ACCR", dimension="ACCURACY", table=t, column=c, ordinal=F.col("ordinal"),
              check_type="RANGE", threshold=0, min_value=0.0, rule=F.concat(quoted, F.lit(" must be >= 0"))),
    ]
    if hubs is not None:
        bk = hubs.select("source_table", F.posexplode("business_keys").alias("p", "k"))
        parts.append(_rule(bk, section=2, prefix="UNIQ", dimension="UNIQUENESS", table=F.col("source_table"),
                           column=F.col("k"), ordinal=F.col("p"), check_type="UNIQUE", threshold=0,
                           rule=F.concat(F.lit("Business key "), q, F.col("k"), q, F.lit(" must be unique"))))
        parts.append(_rule(hubs, section=2, prefix="UNIQ", dimension="UNIQUENESS", table=F.col("hub_name"),
                           column=F.col("hash_key"), ordinal=0, check_type="UNIQUE", threshold=0,
                           rule=F.concat(F.lit("Hub hash key "), q, F.col("hash_key"), q, F.lit(" must be unique"))))
    if links is not None:
        parts.append(_rule(links, section=4, prefix="CONS", dimension="CONSISTENCY", table=F.col("link_name"),
                           column=F.col("hub_a_hk"), ordinal=0, check_type="REFERENTIAL_INTEGRITY", threshold=0,
                           ref_table=F.concat(F.lit("hub_"), F.lower("entity_a")), ref_column=F.col("hub_a_hk"),
                           rule=F.concat(F.lit("FK "), q, F.col("hub_a_hk"), q, F.lit(" must exist in "),
                                         F.col("entity_a"), F.lit(" Hub"))))
    if sttm is not None:
        pii = sttm.filter((F.col("pii_flag") == "Y") & (F.col("source_column") != ""))
        parts.append(_rule(pii, section=5, prefix="PII", dimension="COMPLETENESS", table=F.col("source_table"),
                           column=F.col("source_column"), ordinal=0, check_type="NOT_NULL", threshold=0,
                           rule=F.concat(F.lit("PII column "), q, F.col("source_column"), q, F.lit(" must not be NULL"))))
    rules = reduce(DataFrame.unionByName, parts)
    rule_id = F.lit(None).cast("string")
    if numbered:
        rules = with_running_number(rules, ["section", "table", "ordinal", "column", "check_type"], "__n")
        rule_id = F.format_string("DQ_%s_%04d", "prefix", "__n")
    return rules.select(rule_id.alias("rule_id"), *cols([f for f in RULE_FIELDS if f not in ("section", "prefix", "ordinal")]))


def infer_column_rules(columns: DataFrame) -> DataFrame:
    """Rule names per column from its target name, type, key and nullability, with the critical flag.

    Expects ``target_column, data_type, is_pk, nullable``; adds ``dq_rules, n_rules, is_critical``.
    """
    name, kind = F.upper("target_column"), F.upper("data_type")
    pk, nullable = F.col("is_pk"), F.col("nullable")

    def named(rule: str, test: Column) -> Column:
        return F.when(test, F.lit(rule))

    dates = kind.contains("DATE") | kind.contains("TIME")
    rules = F.array_compact(F.array(
        named("accepted_values", _contains_any(name, ["STATUS", "CODE", "TYPE"])),
        named("date_format", dates),
        named("load_date_current", name.isin("LOAD_DATE", "LOAD_DT")),
        named("no_future_dates", dates),
        named("not_null", pk | ~nullable),
        named("pattern_match", name.contains("EMAIL")),
        named("positive_values", _contains_any(name, AMOUNT_NAMES)),
        named("referential_int", _contains_any(name, ["_ID", "_KEY"]) & ~pk),
        named("unique", pk),
    ))
    return (columns.withColumn("dq_rules", rules).withColumn("n_rules", F.size("dq_rules"))
            .withColumn("is_critical", pk | ~nullable))


def critical(columns: DataFrame) -> DataFrame:
    return columns.filter(F.col("is_critical"))


def rule_totals(columns: DataFrame) -> DataFrame:
    """Columns, columns with rules, critical columns and rules applied."""
    return columns.agg(F.count("*").alias("total_columns"), F.count_if(F.col("n_rules") > 0).alias("columns_with_rules"),
                       F.count_if(F.col("is_critical")).alias("critical_columns"),
                       F.coalesce(F.sum("n_rules"), F.lit(0)).alias("total_rules"))
