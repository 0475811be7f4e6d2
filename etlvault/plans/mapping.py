"""Source-to-target mapping: build, summarise, split and run it."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from etlvault.functions.columns import cols
from etlvault.operators.ordered import first_by, with_running_number

UNMAPPED = "*** UNMAPPED ***"

# Name parts that mark personal data, by use.
PII_WORDS_STTM = ["email", "ssn", "phone", "credit", "card", "dob", "birth", "address", "passport", "license",
                  "national_id", "tax_id", "name", "ip_address"]
PII_WORDS_VAULT = ["email", "ssn", "phone", "credit", "card", "dob", "birth", "address", "passport", "license",
                   "name", "ip_address", "tax"]
PII_WORDS_SHEET = ["email", "phone", "ssn", "dob", "passport", "credit_card", "ip_address", "name", "address"]
# Expression classes in the order they are tried.
EXPRESSION_CLASSES = {
    "HASH": ["MD5", "SHA", "HASH"],
    "AGGREGATE": ["SUM", "AVG", "COUNT", "MAX", "MIN"],
    "CONDITIONAL": ["CASE", "IFF", "DECODE", "NVL", "COALESCE"],
    "STRING_TRANSFORM": ["TRIM", "UPPER", "LOWER", "CONCAT", "||", "SUBSTR"],
    "TYPE_CAST": ["CAST", "TO_DATE", "TO_TIMESTAMP", "TO_NUMBER"],
    "LOOKUP": ["JOIN", "LOOKUP"],
}
STTM_FIELDS = ["mapping_id", "tool", "source_schema", "source_table", "source_column", "source_data_type", "target_database",
               "target_schema", "target_table", "target_column", "target_data_type", "transformation_type", "expression",
               "nullable", "is_pk", "is_fk", "pii_flag", "notes"]


def contains_any(text: Column, words: Sequence[str]) -> Column:
    return reduce(Column.__or__, [text.contains(w) for w in words])


def pii_flag(name: Column, words: Sequence[str] = PII_WORDS_STTM) -> Column:
    return F.when(contains_any(F.lower(name), words), "Y").otherwise("N")


def expression_class(expression: Column) -> Column:
    """Class of an expression by the first list with a hit; a plain substring test, as documented."""
    text = F.upper(expression)
    picked = F.when(expression.isNull() | (expression == ""), "DIRECT")
    for name, words in EXPRESSION_CLASSES.items():
        picked = picked.when(contains_any(text, words), name)
    return picked.otherwise("EXPRESSION")


def short_expression_class(expression: Column, source_column: Column) -> Column:
    """DIRECT for no expression or the bare source column, HASH for digests, else EXPRESSION."""
    return F.when(expression.isNull() | expression.isin("", "DIRECT") | (expression == source_column), "DIRECT").when(
        contains_any(F.upper(expression), ["MD5", "SHA"]), "HASH").otherwise("EXPRESSION")


def _yes(test: Column) -> Column:
    return F.when(test, "Y").otherwise("N")


def build_sttm(catalog: DataFrame, mappings: DataFrame, transforms: DataFrame, target_database: str, target_schema: str,
               list_all_sources: bool = False, numbered: bool = True) -> DataFrame:
    """One row per distinct column mapping, then the source columns no mapping reads.

    Source and target attributes come from the catalogs, first table wins; a mapping
    without expression takes the first transformation of its source column.
    ``list_all_sources`` lists every source column after the mappings, mapped or not.
    ``numbered=False`` leaves ``mapping_id`` NULL for uses that do not show it: numbering sorts
    all rows and runs jobs at once, everything else here is one lazy plan.
    """
    key = ["source_table", "source_column", "target_table", "target_column"]
    order = ["tool", "source_file", "job", "ordinal", "expression"]
    distinct = first_by(mappings.select(*cols(key + order)), key, order)

    column_order = ["tool", "source_file", "position", "ordinal"]
    source = first_by(
        catalog.filter("role = 'source'").select("table_name", "column_name", *column_order, "data_type", "nullable", "key_type"),
        ["table_name", "column_name"], column_order)
    schemas = first_by(catalog.filter("role = 'source'").select("table_name", *column_order, "schema_name"), ["table_name"], column_order)
    target = first_by(catalog.filter("role = 'target'").select("table_name", "column_name", *column_order, "data_type"),
                      ["table_name", "column_name"], column_order)
    rule_order = ["tool", "source_file", "job", "ordinal"]
    rules = first_by(transforms.filter("field <> ''").select(F.upper("field").alias("field"), *rule_order, "expression"),
                     ["field"], rule_order)

    s = source.select(F.col("table_name").alias("source_table"), F.col("column_name").alias("source_column"),
                      F.col("data_type").alias("source_data_type"), F.col("nullable").alias("s_nullable"), F.upper("key_type").alias("s_key"))
    t = target.select(F.col("table_name").alias("target_table"), F.col("column_name").alias("target_column"),
                      F.col("data_type").alias("target_data_type"))
    columns = catalog.filter("role = 'source'")
    used = mappings.select(F.col("source_table").alias("table_name"), F.col("source_column").alias("column_name")).distinct()
    if not list_all_sources:
        columns = columns.join(used, ["table_name", "column_name"], "left_anti")

    blank = F.lit("")
    attributes = {"source_schema": "string", "source_data_type": "string", "s_nullable": "boolean", "s_key": "string"}
    read = distinct.select(F.lit(1).alias("__section"), *order[:3], F.col("ordinal").cast("bigint").alias("__ordinal"), *key, "expression",
                           *[F.lit(None).cast(t).alias(n) for n, t in attributes.items()])
    unread = columns.select(
        F.lit(2).alias("__section"), *order[:3], (F.col("position") * F.lit(100_000).cast("bigint") + F.col("ordinal")).alias("__ordinal"),
        F.col("table_name").alias("source_table"), F.col("column_name").alias("source_column"), F.lit(UNMAPPED).alias("target_table"),
        blank.alias("target_column"), blank.alias("expression"), F.col("schema_name").alias("source_schema"),
        F.col("data_type").alias("source_data_type"), F.col("nullable").alias("s_nullable"), F.upper("key_type").alias("s_key"))
    # numbered while the rows are narrow: the sort behind it reads its input twice
    rows = read.unionByName(unread)
    if numbered:
        rows = with_running_number(rows, ["__section", *order[:3], "__ordinal", *key], "__n")
    rows = rows.withColumn("mapping_id", F.format_string("MAP_%04d", "__n") if numbered else F.lit(None).cast("string"))

    # every lookup side is unique on its key, so the joins keep the mapping rows one to one; what depends on the source
    # column alone is looked up once per column, so that the mapping rows are moved for two joins instead of four
    read_columns = used.select(F.col("table_name").alias("source_table"), F.col("column_name").alias("source_column"))
    lookups = (
        read_columns.join(s, ["source_table", "source_column"], "left")
        .join(schemas.select(F.col("table_name").alias("source_table"), F.col("schema_name").alias("source_schema")), ["source_table"], "left")
        .withColumn("field", F.upper("source_column"))
        .join(rules.select("field", F.col("expression").alias("rule")), ["field"], "left").drop("field")
        .withColumnsRenamed({"source_table": "__table", "source_column": "__column"})
    )
    same_column = F.col("source_table").eqNullSafe(F.col("__table")) & F.col("source_column").eqNullSafe(F.col("__column"))
    found = (
        rows.filter("__section = 1").drop(*attributes)
        .join(lookups, same_column, "left").drop("__table", "__column")
        .join(t, ["target_table", "target_column"], "left")
        .withColumn("expression", F.coalesce(F.nullif("expression", blank), "rule", blank))
        .withColumns({"target_database": F.lit(target_database), "target_schema": F.lit(target_schema), "notes": blank,
                      "transformation_type": expression_class(F.col("expression"))})
    )
    open_ones = rows.filter("__section = 2").withColumns({
        "target_database": blank, "target_schema": blank, "target_data_type": blank, "transformation_type": F.lit("NONE"),
        "notes": F.lit("UNMAPPED — review required")})

    def finished(part: DataFrame) -> DataFrame:
        made = {
            "nullable": F.when(F.col("s_nullable").isNull(), blank).otherwise(_yes(F.col("s_nullable"))),
            "is_pk": _yes(F.coalesce(F.col("s_key").contains("PRIMARY"), F.lit(False))),
            "is_fk": _yes(F.coalesce(F.col("s_key").contains("FOREIGN"), F.lit(False))),
            "pii_flag": pii_flag(F.col("source_column")),
            **{c: F.coalesce(c, blank) for c in ("source_schema", "source_data_type", "target_data_type")},
        }
        return part.withColumns(made).select(*STTM_FIELDS)

    return finished(found).unionByName(finished(open_ones))


def mapped(sttm: DataFrame) -> DataFrame:
    return sttm.filter(F.col("target_table") != UNMAPPED)


def unmapped(sttm: DataFrame) -> DataFrame:
    return sttm.filter(F.col("target_table") == UNMAPPED)


def personal(sttm: DataFrame) -> DataFrame:
    return sttm.filter(F.col("pii_flag") == "Y")


def summarise(sttm: DataFrame) -> DataFrame:
    real = F.col("target_table") != UNMAPPED
    return sttm.agg(
        F.count("*").alias("total_mappings"), F.count_if(real).alias("mapped"), F.count_if(~real).alias("unmapped"),
        F.count_if(F.col("pii_flag") == "Y").alias("pii_columns"),
        F.count_if(~F.col("transformation_type").isin("DIRECT", "NONE", "")).alias("transformations"),
        F.count_distinct("source_table").alias("source_tables"),
        F.count_distinct(F.when(real, F.col("target_table"))).alias("target_tables"))


def summarise_by(sttm: DataFrame, by: Sequence[str] = ("tool",)) -> DataFrame:
    """Mapping counts per tool, or per tool and load strategy where a mapping carries one."""
    direct = F.col("transformation_type") == "DIRECT"
    return sttm.groupBy(*cols(by)).agg(
        F.count("*").alias("mappings"), F.count_if(F.col("is_pk") == "Y").alias("pk_columns"),
        F.count_if(direct).alias("direct"), F.count_if(~direct & (F.col("transformation_type") != "NONE")).alias("transformed"))


def sheet(mappings: DataFrame) -> DataFrame:
    """The mappings as a listing: short expression classes, and the personal data of target columns marked PII."""
    expression = F.coalesce(F.nullif("expression", F.lit("")), F.lit("DIRECT"))
    personal_name = contains_any(F.lower("target_column"), PII_WORDS_SHEET)
    return mappings.select("source_file", "source_table", "source_column", "target_table", "target_column", expression.alias("expression"),
                           short_expression_class(F.col("expression"), F.col("source_column")).alias("transformation_type"),
                           F.when(personal_name, "PII").otherwise("").alias("pii_flag"))


def summarise_loads(columns: DataFrame, parts: int | None = None) -> DataFrame:
    """Mappings and their columns per tool and load strategy, per tool, per strategy and in all; NULL stands for all.

    Takes mappings as one row per column: ``mapping_name``, ``tool``, ``load_strategy``, ``is_pk``,
    ``transformation_type``. A mapping is one row before the totals are made; tools and strategies that are NULL count as ''.
    ``parts`` deals the rows by mapping before they are grouped, for mappings of few columns each, where map-side partials hold about all rows
    of a task: a task then keeps the mappings of one part and no more.
    """
    known = {c: F.coalesce(c, F.lit("")) for c in ("tool", "load_strategy")}
    rows = columns.select("mapping_name", *[v.alias(c) for c, v in known.items()], (F.col("is_pk") == "Y").alias("pk"),
                          (F.col("transformation_type") == "DIRECT").alias("direct"))
    if parts:
        rows = rows.repartition(parts, "mapping_name", *known)
    per = rows.groupBy("mapping_name", *known).agg(F.count("*").alias("c"), F.count_if("pk").alias("k"), F.count_if("direct").alias("d"))
    return per.cube(*known).agg(F.count("*").alias("mappings"), F.sum("c").alias("columns"), F.sum("k").alias("pk_columns"),
                                F.sum("d").alias("direct"), (F.sum("c") - F.sum("d")).alias("transformed"))


def explode_mappings(mappings: DataFrame) -> DataFrame:
    """Nested mappings ``(mapping_name, …, columns array)`` as one row per column."""
    return mappings.select(*[c for c in mappings.columns if c != "columns"], F.posexplode("columns").alias("ordinal", "c")).select(
        *[c for c in mappings.columns if c != "columns"], "ordinal", "c.*")


# Spellings of other dialects that Spark SQL writes differently.
_DIALECT = [
    (re.compile(r"\bTO_CHAR\s*\(\s*(\w+)\s*\)", re.I), r"CAST(\1 AS STRING)"),
    (re.compile(r"\bAS\s+(?:N?VARCHAR2?|TEXT)\b(?:\s*\(\s*\d+\s*\))?", re.I), "AS STRING"),
    (re.compile(r"\bIFF\s*\(", re.I), "IF("),
    (re.compile(r"\bTO_NUMBER\s*\(\s*(\w+)\s*\)", re.I), r"TRY_CAST(\1 AS DOUBLE)"),
]


def spark_expression(expression: str, column: str, load_date: str) -> str:
    """Mapping expression in Spark SQL; empty or DIRECT copies the source column."""
    if not expression.strip() or expression.strip().upper() == "DIRECT":
        return f"`{column}`"
    text = re.sub(r"\b(?:SYSDATE|CURRENT_TIMESTAMP(?:\(\))?)", f"TIMESTAMP_NTZ'{load_date}'", expression, flags=re.I)
    for pattern, replacement in _DIALECT:
        text = pattern.sub(replacement, text)
    return text


def apply_sttm(source: DataFrame, rows: Sequence[Mapping[str, str]], load_date: str) -> DataFrame:
    """Run the mapping of one target table as a single projection over its source."""
    return source.select(*[
        F.expr(spark_expression(r.get("expression") or "", r["source_column"], load_date)).alias(r["target_column"]) for r in rows])
