"""Metadata catalogs that Spark derives from the given tables, so that catalog work grows with them.

Every part is a column: sixteen neighbouring parts describe one entity, eight of them in a
source table and eight in a dimension table. Every supplier is a column of its target
table and every order line maps its part's column to its supplier's table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from etlvault.workload.tables import table, wide

SPAN, HALF = 16, 8


def columns(spark, sf_dir) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("h", F.floor(F.col("p_partkey") / SPAN))
    base = part.groupBy("h").agg(F.upper(F.replace(F.min_by("p_name", "p_partkey"), F.lit(" "), F.lit("_"))).alias("base"))
    at = F.col("p_partkey") - F.col("h") * SPAN
    source = at < HALF
    word = F.upper(F.replace("p_name", F.lit(" "), F.lit("_")))
    other = F.concat(F.lit("T"), F.lpad((F.col("h") + F.col("p_size")).cast("string"), 9, "0"))
    kind = F.col("p_type")
    name = (F.when(kind == "STANDARD", F.concat(other, F.lit("_ID"))).when(kind == "LARGE", F.concat(word, F.lit("_ID")))
            .when(kind == "MEDIUM", F.concat(word, F.lit("_AMOUNT"))).when(kind == "SMALL", F.concat(word, F.lit("_DATE")))
            .when(kind == "ECONOMY", F.concat(word, F.lit("_EMAIL"))).otherwise(F.concat(word, F.lit("_CODE"))))
    data_type = (F.when(kind.isin("STANDARD", "LARGE"), "INTEGER").when(kind == "MEDIUM", "DECIMAL(18,2)")
                 .when(kind == "SMALL", "DATE").when(kind == "ECONOMY", "VARCHAR(100)").otherwise("CHAR(2)"))
    ordinal = F.when(source, at).otherwise(at - HALF).cast("int")
    table_name = F.concat(F.when(source, "SRC_").otherwise("DIM_"), F.col("base"), F.lit("_T"), F.lpad(F.col("h").cast("string"), 9, "0"))
    return part.join(base, "h").select(
        "p_partkey", F.when(source, "job_export").otherwise("mapping_export").alias("tool"), F.lit("part").alias("source_file"),
        F.lit("").alias("job"), F.lit(0).alias("position"), table_name.alias("table_name"), F.col("p_brand").alias("schema_name"),
        F.lit("source").alias("role"), ordinal.alias("ordinal"), name.alias("column_name"), data_type.alias("data_type"),
        F.lit("").alias("length"), (F.col("p_size") > 25).alias("nullable"),
        F.when((ordinal == 0) & (F.col("p_size") > 10), "PRIMARY KEY").when(kind == "STANDARD", "FOREIGN KEY")
        .otherwise("NOT A KEY").alias("key_type"), F.lit("").alias("expression"))


def catalog(spark, sf_dir) -> DataFrame:
    """Source columns from part, target columns from supplier."""
    source = columns(spark, sf_dir).drop("p_partkey")
    target = table(spark, sf_dir, "supplier").select(
        F.lit("mapping_export").alias("tool"), F.lit("supplier").alias("source_file"), F.lit("").alias("job"), F.lit(0).alias("position"),
        _target().alias("table_name"), F.lit("DW").alias("schema_name"), F.lit("target").alias("role"), F.lit(0).alias("ordinal"),
        F.lit("S_NAME").alias("column_name"), F.lit("VARCHAR(25)").alias("data_type"), F.lit("25").alias("length"), F.lit(True).alias("nullable"),
        F.lit("NOT A KEY").alias("key_type"), F.lit("").alias("expression"))
    return source.unionByName(target)


def _target(key: str = "s_suppkey"):
    return F.concat(F.lit("TGT_S"), F.lpad(F.col(key).cast("string"), 9, "0"))


def mappings(spark, sf_dir) -> DataFrame:
    c = columns(spark, sf_dir).select("p_partkey", "tool", "table_name", "column_name")
    lines = wide(spark, sf_dir, "lineitem", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")
    name = F.col("column_name")
    expression = (F.when(F.col("l_returnflag") == "A", "").when(F.col("l_returnflag") == "N", F.concat(F.lit("UPPER("), name, F.lit(")")))
                  .otherwise(F.concat(F.lit("NVL("), name, F.lit(", 0)"))))
    return lines.join(c, F.col("l_partkey") == F.col("p_partkey")).select(
        "tool", F.lit("lineitem").alias("source_file"), F.lit("").alias("job"), F.col("l_linenumber").alias("ordinal"),
        F.col("table_name").alias("source_table"), name.alias("source_column"), _target("l_suppkey").alias("target_table"),
        F.when(F.col("l_linestatus") == "O", "S_NAME").otherwise(name).alias("target_column"), expression.alias("expression"))


def transforms(spark, sf_dir) -> DataFrame:
    name = F.col("column_name")
    shown = F.when(F.col("data_type").isin("CHAR(2)", "VARCHAR(100)"), F.concat(F.lit("TRIM("), name, F.lit(")"))).otherwise(
        F.concat(F.lit("SUM("), name, F.lit(")")))
    return columns(spark, sf_dir).select("tool", "source_file", "job", F.col("p_partkey").alias("ordinal"), F.lit("EXP").alias("name"),
                                         F.lit("expression").alias("type"), name.alias("field"), shown.alias("expression"), "data_type")


CATALOG_SQL = f"""
base as (select p_partkey // {SPAN} as h, upper(replace(min_by(p_name, p_partkey), ' ', '_')) as base from part group by 1),
cat0 as (select part.*, h, base, p_partkey - h * {SPAN} as slot, upper(replace(p_name, ' ', '_')) as word
         from part join base on p_partkey // {SPAN} = h),
cat as (
  select p_partkey, case when slot < {HALF} then 'job_export' else 'mapping_export' end as tool, 'part' as source_file,
         (case when slot < {HALF} then 'SRC_' else 'DIM_' end) || base || '_T' || lpad(cast(h as varchar), 9, '0') as table_name,
         p_brand as schema_name, cast(case when slot < {HALF} then slot else slot - {HALF} end as int) as ordinal,
         case p_type when 'STANDARD' then 'T' || lpad(cast(h + p_size as varchar), 9, '0') || '_ID' when 'LARGE' then word || '_ID'
              when 'MEDIUM' then word || '_AMOUNT' when 'SMALL' then word || '_DATE' when 'ECONOMY' then word || '_EMAIL'
              else word || '_CODE' end as column_name,
         case when p_type in ('STANDARD', 'LARGE') then 'INTEGER' when p_type = 'MEDIUM' then 'DECIMAL(18,2)' when p_type = 'SMALL' then 'DATE'
              when p_type = 'ECONOMY' then 'VARCHAR(100)' else 'CHAR(2)' end as data_type,
         p_size > 25 as nullable,
         case when slot in (0, {HALF}) and p_size > 10 then 'PRIMARY KEY' when p_type = 'STANDARD' then 'FOREIGN KEY' else 'NOT A KEY' end as key_type
  from cat0),
maps as (
  select tool, l_linenumber as ordinal, table_name as source_table, column_name as source_column,
         'TGT_S' || lpad(cast(l_suppkey as varchar), 9, '0') as target_table,
         case when l_linestatus = 'O' then 'S_NAME' else column_name end as target_column,
         case l_returnflag when 'A' then '' when 'N' then 'UPPER(' || column_name || ')' else 'NVL(' || column_name || ', 0)' end as expression
  from lineitem join cat on l_partkey = p_partkey)"""
