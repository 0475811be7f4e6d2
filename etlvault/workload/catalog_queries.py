"""Harvest, mapping and model queries over the derived catalogs; the mapping run over customer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from etlvault.operators import quality
from etlvault.plans import mapping, model, rules
from etlvault.session import cut_lineage, task_parts
from etlvault.sources import artifacts
from etlvault.workload import derived
from etlvault.workload.tables import table

CATALOG_COLUMNS = ["table_name", "ordinal", "column_name", "data_type", "nullable", "key_type"]
LOAD_DATE = "2024-01-01 00:00:00"
LOAD_ROWS = 500_000  # mapping rows that a task groups at once
FILE_PARTS = 50_000  # rows of part whose files a task reads; sixteen rows make eight files


def _lines(catalog: DataFrame, text, separator: str) -> DataFrame:
    """One text per table from its eight columns, in order."""
    entry = F.struct("ordinal", text.alias("t"))
    return catalog.groupBy("tool", "table_name", "schema_name_of_table").agg(F.array_join(
        F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["t"]), separator).alias("body"))


def _tables(spark, sf_dir) -> DataFrame:
    return derived.columns(spark, sf_dir).withColumn("schema_name_of_table", F.col("tool"))


def scripts(spark, sf_dir) -> DataFrame:
    line = F.concat(F.lit("  "), "column_name", F.lit(" "), "data_type", F.when(F.col("nullable"), "").otherwise(" NOT NULL"),
                    F.when(F.col("key_type") == "PRIMARY KEY", " PRIMARY KEY").when(F.col("key_type") == "FOREIGN KEY", " REFERENCES X").otherwise(""))
    made = _lines(_tables(spark, sf_dir), line, ",\n")
    return made.select(F.concat("table_name", F.lit(".sql")).alias("path"), F.concat(
        F.lit("-- load of "), "table_name", F.lit("\n/* CREATE TABLE old (x INT); */\nCREATE TABLE "), "table_name", F.lit(" (\n"), "body",
        F.lit("\n);\nINSERT INTO TGT_"), "table_name", F.lit(" (K, V)\nSELECT MD5(CAST(ID AS VARCHAR)), NVL(V, 0)\nFROM "), "table_name",
        F.lit(" WHERE V > 0;\nCREATE VIEW V_"), "table_name", F.lit(" AS\nSELECT K, V FROM "), "table_name", F.lit(";")).alias("content"))


def job_exports(spark, sf_dir) -> DataFrame:
    line = F.concat(F.lit('<Column Identifier="'), "column_name", F.lit('" SqlType="'), "data_type", F.lit('" Nullable="'),
                    F.when(F.col("nullable"), "Y").otherwise("N"), F.lit('"/>'))
    made = _lines(_tables(spark, sf_dir), line, "\n")
    return made.select(F.concat("table_name", F.lit(".dsx")).alias("path"), F.concat(
        F.lit('<?xml version="1.0"?>\n<DSExport><Job Identifier="J_'), "table_name",
        F.lit('"><Stage Identifier="IN" StageType="SequentialFile"><Property name="TableName">'), "table_name", F.lit("</Property>"), "body",
        F.lit('</Stage><Stage Identifier="STEP" StageType="Transformer"><Clause Value="X = TRIM(Y)"/></Stage>'
              '<Stage Identifier="OUT" StageType="SequentialFile"><Column Identifier="K" SqlType="INTEGER"/></Stage>'
              '<Link SourceStage="IN" TargetStage="STEP">'), "body", F.lit('</Link><Link SourceStage="STEP" TargetStage="OUT">'
              '<Column Identifier="K" Derivation="MD5(ID)"/></Link></Job></DSExport>')).alias("content"))


def mapping_exports(spark, sf_dir) -> DataFrame:
    field = F.concat(F.lit('<SOURCEFIELD NAME="'), "column_name", F.lit('" DATATYPE="'), "data_type", F.lit('" NULLABLE="'),
                     F.when(F.col("nullable"), "NULL").otherwise("NOT NULL"), F.lit('" KEYTYPE="'), "key_type", F.lit('"/>'))
    made = _lines(_tables(spark, sf_dir), field, "")
    return made.select(F.concat("table_name", F.lit(".xml")).alias("path"), F.concat(
        F.lit('<?xml version="1.0"?>\n<!DOCTYPE POWERMART SYSTEM "powrmart.dtd">\n<POWERMART><REPOSITORY NAME="R"><FOLDER NAME="F"><SOURCE DBDNAME="OPS" NAME="'),
        "table_name", F.lit('">'), "body", F.lit('</SOURCE><MAPPING NAME="M"><TRANSFORMATION NAME="E" TYPE="Expression">'
        '<TRANSFORMFIELD NAME="A" EXPRESSION="MD5(A)"/><TRANSFORMFIELD NAME="B" DEFAULTVALUE="NVL(B, 0)"/><TRANSFORMFIELD NAME="C"/></TRANSFORMATION>'
        '<CONNECTOR FROMINSTANCE="'), "table_name", F.lit('" FROMFIELD="A" TOINSTANCE="TGT" TOFIELD="A_HK"/></MAPPING></FOLDER></REPOSITORY></POWERMART>')).alias("content"))


def replication_tasks(spark, sf_dir) -> DataFrame:
    c = F.struct(F.col("column_name").alias("columnName"), F.col("data_type").alias("dataType"), "nullable",
                 (F.col("key_type") == "PRIMARY KEY").alias("isPrimaryKey"))
    made = _lines(_tables(spark, sf_dir), F.to_json(c), ", ")
    return made.select(F.concat("table_name", F.lit(".atl")).alias("path"), F.concat(
        F.lit('{"task": {"name": "t", "tableRules": [{"tableName": "'), "table_name", F.lit('", "schemaName": "S", "columns": ['), "body",
        F.lit("]}]}}")).alias("content"))


def harvest_ddl(spark, sf_dir):
    return artifacts.harvest_ddl(scripts(spark, sf_dir)).columns.filter("role = 'source'").select(CATALOG_COLUMNS)


def harvest_views(spark, sf_dir):
    """The columns that views show."""
    return artifacts.harvest_ddl(scripts(spark, sf_dir)).columns.filter("role = 'view'").select("table_name", "ordinal", "column_name", "expression")


def harvest_ddl_moves(spark, sf_dir):
    found = artifacts.harvest_ddl(scripts(spark, sf_dir))
    views = found.views.select(F.col("name").alias("target_table"), F.lit("").alias("target_column"), F.col("sql").alias("expression"))
    return found.mappings.select("target_table", "target_column", "expression").unionByName(views)


def harvest_jobs(spark, sf_dir):
    return artifacts.harvest_jobs(job_exports(spark, sf_dir)).columns.select("role", *CATALOG_COLUMNS)


def harvest_job_links(spark, sf_dir):
    return artifacts.harvest_jobs(job_exports(spark, sf_dir)).mappings.select("job", "source_table", "source_column", "target_table", "expression")


def harvest_mappings(spark, sf_dir):
    return artifacts.harvest_mappings(mapping_exports(spark, sf_dir)).columns.select("schema_name", *CATALOG_COLUMNS)


def harvest_transforms(spark, sf_dir):
    found = artifacts.harvest_mappings(mapping_exports(spark, sf_dir))
    steps = found.transforms.select(F.regexp_replace("source_file", "\\.xml$", "").alias("source_table"), "field", "expression")
    wires = found.mappings.select("source_table", F.col("source_column").alias("field"), F.col("target_column").alias("expression"))
    return steps.unionByName(wires)


def harvest_replication(spark, sf_dir):
    return artifacts.harvest_replication(replication_tasks(spark, sf_dir)).columns.select(CATALOG_COLUMNS)


def harvest_all(spark, sf_dir):
    """All four kinds of files together, routed by extension and merged: columns per tool and role."""
    files = scripts(spark, sf_dir).unionByName(job_exports(spark, sf_dir)).unionByName(mapping_exports(spark, sf_dir)).unionByName(
        replication_tasks(spark, sf_dir))
    # every harvester reads the folder of files, so it is made once, with files of all kinds in each part
    parts = task_parts(table(spark, sf_dir, "part"), FILE_PARTS)
    return artifacts.harvest(cut_lineage(files.repartition(parts, "path"))).columns.groupBy("tool", "role").agg(
        F.count("*").alias("columns"), F.count_distinct("source_file").alias("files"))


def _sttm(spark, sf_dir, **options):
    return mapping.build_sttm(derived.catalog(spark, sf_dir), derived.mappings(spark, sf_dir), derived.transforms(spark, sf_dir),
                              "ANALYTICS", "DW", **options)


def sttm_build(spark, sf_dir):
    return _sttm(spark, sf_dir)


def sttm_summary(spark, sf_dir):
    return mapping.summarise(_sttm(spark, sf_dir, numbered=False))


def sttm_by_tool(spark, sf_dir):
    return mapping.summarise_by(_sttm(spark, sf_dir, list_all_sources=True, numbered=False))


def sttm_short_classes(spark, sf_dir):
    """Mappings per short class of their expression."""
    kind = mapping.short_expression_class(F.col("expression"), F.col("source_column"))
    return mapping.mapped(_sttm(spark, sf_dir, numbered=False)).groupBy("tool", kind.alias("expression_class")).agg(F.count("*").alias("mappings"))


def sttm_sheet(spark, sf_dir):
    """Rows of the listing of all mappings, by what it shows of each."""
    listed = mapping.sheet(derived.mappings(spark, sf_dir))
    return listed.groupBy("source_table", "target_column", "expression", "transformation_type", "pii_flag").agg(F.count("*").alias("mappings"))


def sttm_loads(spark, sf_dir):
    """A mapping per source and target table; targets of even number are loaded in increments."""
    even = F.right("target_table", F.lit(1)).isin("0", "2", "4", "6", "8")
    key = derived.columns(spark, sf_dir).select(F.col("table_name").alias("source_table"), F.col("column_name").alias("source_column"), "key_type")
    found = derived.mappings(spark, sf_dir).join(
        key.groupBy("source_table", "source_column").agg(F.max(F.when(F.col("key_type") == "PRIMARY KEY", "Y").otherwise("N")).alias("is_pk")),
        ["source_table", "source_column"], "left")
    parts = task_parts(table(spark, sf_dir, "lineitem"), LOAD_ROWS)  # a mapping row per line
    return mapping.summarise_loads(found.select(
        F.concat_ws(" ", "source_table", "target_table").alias("mapping_name"), "tool", F.when(even, "INCREMENTAL").otherwise("FULL").alias("load_strategy"),
        "is_pk", mapping.expression_class(F.col("expression")).alias("transformation_type")), parts)


def sttm_unmapped(spark, sf_dir):
    return mapping.unmapped(_sttm(spark, sf_dir, numbered=False)).select("source_table", "source_column", "is_pk", "is_fk", "pii_flag")


def sttm_personal(spark, sf_dir):
    return mapping.personal(mapping.mapped(_sttm(spark, sf_dir, numbered=False))).groupBy("source_table").agg(F.count("*").alias("pii_mappings"))


CUSTOMER_STTM = [
    {"source_column": "c_custkey", "target_column": "CUSTOMER_HK", "expression": "MD5(TO_CHAR(c_custkey))"},
    {"source_column": "c_custkey", "target_column": "CUSTOMER_BK", "expression": "DIRECT"},
    {"source_column": "c_name", "target_column": "FULL_NAME", "expression": "TRIM(c_name || ' ' || c_mktsegment)"},
    {"source_column": "c_name", "target_column": "NAME_LOWER", "expression": "LOWER(c_name)"},
    {"source_column": "c_mktsegment", "target_column": "SEGMENT", "expression": "UPPER(CAST(c_mktsegment AS VARCHAR(10)))"},
    {"source_column": "c_nationkey", "target_column": "NATION", "expression": "NVL(c_nationkey, 0)"},
    {"source_column": "c_acctbal", "target_column": "IN_DEBT", "expression": "IFF(c_acctbal < 0, 'Y', 'N')"},
    {"source_column": "c_name", "target_column": "RECORD_SOURCE", "expression": "'CRM'"},
    {"source_column": "c_name", "target_column": "LOAD_DATE", "expression": "CAST(SYSDATE AS VARCHAR)"},
]


def sttm_apply(spark, sf_dir):
    return mapping.apply_sttm(table(spark, sf_dir, "customer"), CUSTOMER_STTM, LOAD_DATE)


def _keys(spark, sf_dir, **options):
    return model.business_keys(derived.catalog(spark, sf_dir), **options)


def model_business_keys(spark, sf_dir):
    return _keys(spark, sf_dir).select("tool", "table_name", "entity", F.array_join("business_keys", ",").alias("business_keys"))


def model_primary_keys(spark, sf_dir):
    return _keys(spark, sf_dir, prefer_primary=True).select("table_name", F.array_join("business_keys", ",").alias("business_keys"))


def model_hubs(spark, sf_dir):
    return model.build_hubs(_keys(spark, sf_dir)).withColumn("business_keys", F.array_join("business_keys", ","))


def model_links(spark, sf_dir):
    return model.build_links(derived.catalog(spark, sf_dir))


def model_key_pair_links(spark, sf_dir):
    return model.build_key_pair_links(_keys(spark, sf_dir)).withColumn("fk_hash_keys", F.array_join("fk_hash_keys", ","))


def model_satellites(spark, sf_dir):
    found = model.build_satellites(derived.catalog(spark, sf_dir), _keys(spark, sf_dir))
    return found.select("sat_name", "source_table", "hub_hash_key", "hashdiff", F.array_join(F.transform(
        "attributes", lambda a: F.concat(a["name"], F.lit(":"), model.type_label(a["data_type"]), F.lit(":"), a["pii"].cast("string"))), ",").alias("attributes"))


def model_relationships(spark, sf_dir):
    return model.relationships(derived.catalog(spark, sf_dir))


def model_relationship_ends(spark, sf_dir):
    return model.relationship_ends(derived.catalog(spark, sf_dir))


def dq_rules(spark, sf_dir):
    c = derived.catalog(spark, sf_dir)
    hubs, links = model.build_hubs(model.business_keys(c)), model.build_links(c)
    made = rules.generate_rules(c, hubs, links, _sttm(spark, sf_dir, numbered=False))
    return made.select("rule_id", "dimension", "table", "column", "check_type", "rule")


def dq_dimensions(spark, sf_dir):
    """The catalogue of dimensions with the generated rules of each."""
    counts = dq_rules(spark, sf_dir).groupBy("dimension").agg(F.count("*").alias("n"))
    return quality.dimensions(spark).join(counts, "dimension", "left").select("dimension", "description", F.coalesce("n", F.lit(0)).alias("n_rules"))


def _column_rules(spark, sf_dir):
    c = derived.columns(spark, sf_dir).select("table_name", "ordinal", F.col("column_name").alias("target_column"), "data_type",
                                              (F.col("key_type") == "PRIMARY KEY").alias("is_pk"), "nullable")
    return rules.infer_column_rules(c)


def dq_column_rules(spark, sf_dir):
    return _column_rules(spark, sf_dir).select("table_name", "ordinal", "target_column", F.array_join("dq_rules", ",").alias("dq_rules"),
                                               "n_rules", "is_critical")


def dq_rule_counts(spark, sf_dir):
    return rules.rule_totals(_column_rules(spark, sf_dir))


QUERIES = {
    "harvest_ddl": harvest_ddl, "harvest_views": harvest_views, "harvest_ddl_moves": harvest_ddl_moves, "harvest_jobs": harvest_jobs, "harvest_job_links": harvest_job_links,
    "harvest_mappings": harvest_mappings, "harvest_transforms": harvest_transforms, "harvest_replication": harvest_replication,
    "harvest_all": harvest_all, "sttm_build": sttm_build, "sttm_summary": sttm_summary, "sttm_by_tool": sttm_by_tool,
    "sttm_short_classes": sttm_short_classes, "sttm_sheet": sttm_sheet, "sttm_loads": sttm_loads,
    "sttm_unmapped": sttm_unmapped, "sttm_personal": sttm_personal, "sttm_apply": sttm_apply, "model_business_keys": model_business_keys,
    "model_primary_keys": model_primary_keys, "model_hubs": model_hubs, "model_links": model_links,
    "model_key_pair_links": model_key_pair_links, "model_satellites": model_satellites, "model_relationships": model_relationships,
    "model_relationship_ends": model_relationship_ends,
    "dq_rules": dq_rules, "dq_dimensions": dq_dimensions, "dq_column_rules": dq_column_rules, "dq_rule_counts": dq_rule_counts,
}

_CAT = derived.CATALOG_SQL


def _words(column: str, words) -> str:
    return "(" + " or ".join(f"contains({column}, '{w}')" for w in words) + ")"


_CLASS = "case when {e} = '' then 'DIRECT' " + " ".join(
    f"when {_words('upper({e})', w)} then '{n}'" for n, w in mapping.EXPRESSION_CLASSES.items()) + " else 'EXPRESSION' end"

_STTM = f"""
{_CAT},
m0 as (select * from (select *, row_number() over (partition by source_table, source_column, target_table, target_column
                      order by tool, ordinal, expression) as rn from maps) where rn = 1),
src as (select table_name, column_name, min_by((data_type, nullable, key_type), (tool, ordinal, data_type, nullable, key_type)) as a from cat group by 1, 2),
sch as (select table_name, min_by(schema_name, (tool, ordinal, schema_name)) as schema_name from cat group by 1),
tr as (select column_name as field, min_by(case when data_type in ('CHAR(2)', 'VARCHAR(100)') then 'TRIM(' || column_name || ')' else 'SUM(' || column_name || ')' end,
          (tool, p_partkey)) as rule from cat group by 1),
j as (select m0.*, a, sch.schema_name, case when m0.expression <> '' then m0.expression else coalesce(tr.rule, '') end as e,
        case when m0.target_column = 'S_NAME' then 'VARCHAR(25)' else '' end as target_data_type
      from m0 left join src on src.table_name = source_table and src.column_name = source_column
      left join sch on sch.table_name = source_table left join tr on field = upper(source_column)),
rws as (
  select 1 as part, tool, 'lineitem' as f, cast(ordinal as bigint) as o, schema_name as source_schema, source_table, source_column,
         a[1] as source_data_type, 'ANALYTICS' as target_database, 'DW' as target_schema, target_table, target_column, target_data_type,
         {_CLASS.replace('{e}', 'e')} as transformation_type, e as expression, case when a[2] then 'Y' else 'N' end as nullable,
         case when contains(a[3], 'PRIMARY') then 'Y' else 'N' end as is_pk, case when contains(a[3], 'FOREIGN') then 'Y' else 'N' end as is_fk,
         case when {_words('lower(source_column)', mapping.PII_WORDS_STTM)} then 'Y' else 'N' end as pii_flag, '' as notes from j
  union all
  select 2, tool, 'part', ordinal, schema_name, table_name, column_name, data_type, '', '', '{mapping.UNMAPPED}', '', '', 'NONE', '',
         case when nullable then 'Y' else 'N' end, case when contains(key_type, 'PRIMARY') then 'Y' else 'N' end,
         case when contains(key_type, 'FOREIGN') then 'Y' else 'N' end,
         case when {_words('lower(column_name)', mapping.PII_WORDS_STTM)} then 'Y' else 'N' end, 'UNMAPPED — review required'
  from cat where %s),
num as (select *, row_number() over (order by part, tool, f, o, source_table, source_column, target_table, target_column) as n from rws),
sttm as (
  select 'MAP_' || case when n < 10000 then lpad(cast(n as varchar), 4, '0') else cast(n as varchar) end as mapping_id, * exclude (part, f, o, n) from num)"""

_STTM_ALL = _STTM % "true"
_STTM = _STTM % "(table_name, column_name) not in (select (source_table, source_column) from m0)"

_ENTITY = "upper(regexp_replace(table_name, '^(SRC_|TGT_|STG_|DIM_|FACT_|ODS_|RAW_)', '', 'i'))"
_IS_KEY = r"(contains(key_type, 'PRIMARY') or regexp_matches(upper(column_name), '(_ID|_CODE|_KEY|_NUM|_NO)$'))"


def _bk(test: str) -> str:
    return f"""
kc as (select tool, table_name, column_name, min(ordinal) as o from cat where {test} group by all),
kk as (select tool, table_name, list(column_name order by o) as k from kc group by all),
bk as (select t.tool, t.table_name, {_ENTITY.replace('table_name', 't.table_name')} as entity, coalesce(k, [t.c]) as k
       from (select tool, table_name, min_by(column_name, (ordinal, column_name)) as c from cat group by all) t
       left join kk on kk.tool = t.tool and kk.table_name = t.table_name)"""


_KEYS = f"{_CAT}, {_bk(_IS_KEY)}"
_PRIMARY = f"""{_CAT}, pt as (select distinct tool, table_name from cat where contains(key_type, 'PRIMARY')),
{_bk(f"case when (tool, table_name) in (select (tool, table_name) from pt) then contains(key_type, 'PRIMARY') else {_IS_KEY} end")}"""
_HUBS = f"hubs as (select entity, min_by((table_name, k), (tool, table_name)) as f from bk group by 1)"
_LINKS = f"""
lp as (select distinct least(a, b) as a, greatest(a, b) as b from (
         select {_ENTITY} as a, regexp_extract(upper(column_name), '^([A-Z_]+?)_ID$', 1) as b from cat) where b <> '' and a <> b)"""

_RULES = f"""
{_STTM}, {_bk(_IS_KEY)}, {_HUBS}, {_LINKS},
r as (
  select 1 as s, 'COMP' as p, 'COMPLETENESS' as dimension, table_name as t, column_name as c, ordinal as o, 'NOT_NULL' as k,
         'Column ''' || column_name || ''' must not be NULL' as rule from cat where not nullable
  union all select 3, 'VALD', 'VALIDITY', table_name, column_name, ordinal, 'REGEX', '''' || column_name || ''' must match email format'
         from cat where contains(lower(column_name), 'email')
  union all select 3, 'VALD', 'TIMELINESS', table_name, column_name, ordinal, 'DATE_RANGE', '''' || column_name || ''' must be between 1900-01-01 and today'
         from cat where contains(data_type, 'DATE') or contains(data_type, 'TIMESTAMP') or contains(lower(column_name), 'date')
  union all select 3, 'ACCR', 'ACCURACY', table_name, column_name, ordinal, 'RANGE', '''' || column_name || ''' must be >= 0'
         from cat where {_words('lower(column_name)', rules.AMOUNT_WORDS)} and contains(data_type, 'DECIMAL')
  union all select 2, 'UNIQ', 'UNIQUENESS', t, c, cast(i - 1 as int), 'UNIQUE', 'Business key ''' || c || ''' must be unique'
         from (select f[1] as t, unnest(f[2]) as c, unnest(range(1, len(f[2]) + 1)) as i from hubs)
  union all select 2, 'UNIQ', 'UNIQUENESS', 'HUB_' || entity, entity || '_HK', 0, 'UNIQUE', 'Hub hash key ''' || entity || '_HK'' must be unique' from hubs
  union all select 4, 'CONS', 'CONSISTENCY', 'LNK_' || a || '_' || b, a || '_HK', 0, 'REFERENTIAL_INTEGRITY', 'FK ''' || a || '_HK'' must exist in ' || a || ' Hub' from lp
  union all select 5, 'PII', 'COMPLETENESS', source_table, source_column, 0, 'NOT_NULL', 'PII column ''' || source_column || ''' must not be NULL' from sttm where pii_flag = 'Y'),
rn as (select *, row_number() over (order by s, t, o, c, k) as n from r)"""

_RULE_TESTS = [
    ("accepted_values", _words("n", ["STATUS", "CODE", "TYPE"])), ("date_format", _words("k", ["DATE", "TIME"])),
    ("load_date_current", "n in ('LOAD_DATE', 'LOAD_DT')"), ("no_future_dates", _words("k", ["DATE", "TIME"])), ("not_null", "(pk or not nullable)"),
    ("pattern_match", "contains(n, 'EMAIL')"), ("positive_values", _words("n", rules.AMOUNT_NAMES)),
    ("referential_int", f"({_words('n', ['_ID', '_KEY'])} and not pk)"), ("unique", "pk")]
_COLUMN_RULES = f"""{_CAT}, cr as (
  select table_name, ordinal, column_name as target_column, list_filter([{', '.join(f"case when {t} then '{r}' end" for r, t in _RULE_TESTS)}], lambda x: x is not null) as l,
         pk or not nullable as is_critical
  from (select *, upper(column_name) as n, upper(data_type) as k, key_type = 'PRIMARY KEY' as pk from cat))"""

_TYPE = """case when contains(data_type, 'CHAR') then 'string' when contains(data_type, 'DECIMAL') then 'float' when contains(data_type, 'INT') then 'int' else 'date' end"""

ORACLE = {
    "harvest_ddl": f"with {_CAT} select table_name, ordinal, column_name, data_type, nullable, case when key_type = 'NOT A KEY' then '' else key_type end as key_type from cat",
    "harvest_views": f"""with {_CAT}, t as (select distinct table_name from cat)
        select 'V_' || table_name as table_name, 0 as ordinal, 'K' as column_name, 'K' as expression from t union all select 'V_' || table_name, 1, 'V', 'V' from t""",
    "harvest_ddl_moves": f"""with {_CAT}, t as (select distinct table_name from cat)
        select 'TGT_' || table_name as target_table, 'K' as target_column, 'MD5(CAST(ID AS VARCHAR))' as expression from t
        union all select 'TGT_' || table_name, 'V', 'NVL(V, 0)' from t
        union all select 'V_' || table_name, '', 'SELECT K, V FROM ' || table_name || ';' from t""",
    "harvest_jobs": f"""with {_CAT}
        select 'source' as role, table_name, ordinal, column_name, data_type, nullable, '' as key_type from cat
        union all select 'target', 'OUT', 0, 'K', 'INTEGER', true, '' from (select distinct table_name from cat)""",
    "harvest_job_links": f"""with {_CAT}
        select 'J_' || table_name as job, 'IN' as source_table, column_name as source_column, 'STEP' as target_table, '' as expression from cat
        union all select 'J_' || table_name, 'STEP', 'K', 'OUT', 'MD5(ID)' from (select distinct table_name from cat)""",
    "harvest_mappings": f"with {_CAT} select 'OPS' as schema_name, table_name, ordinal, column_name, data_type, nullable, key_type from cat",
    "harvest_transforms": f"""with {_CAT}, t as (select distinct table_name from cat)
        select table_name as source_table, 'A' as field, 'MD5(A)' as expression from t
        union all select table_name, 'B', 'NVL(B, 0)' from t union all select table_name, 'A', 'A_HK' from t""",
    "harvest_replication": f"""with {_CAT} select table_name, ordinal, column_name, data_type, nullable,
        case when key_type = 'PRIMARY KEY' then key_type else '' end as key_type from cat""",
    "harvest_all": f"""with {_CAT}, t as (select count(distinct table_name) as files, count(*) as n from cat)
        select unnest(['script', 'job_export', 'mapping_export', 'replication']) as tool, 'source' as role, n as columns, files from t
        union all select 'job_export', 'target', files, files from t union all select 'script', 'view', 2 * files, files from t""",
    "sttm_build": f"with {_STTM} select * from sttm",
    "sttm_summary": f"""with {_STTM} select count(*) as total_mappings, count(*) filter (where target_table <> '{mapping.UNMAPPED}') as mapped,
        count(*) filter (where target_table = '{mapping.UNMAPPED}') as unmapped, count(*) filter (where pii_flag = 'Y') as pii_columns,
        count(*) filter (where transformation_type not in ('DIRECT', 'NONE', '')) as transformations, count(distinct source_table) as source_tables,
        count(distinct target_table) filter (where target_table <> '{mapping.UNMAPPED}') as target_tables from sttm""",
    "sttm_by_tool": f"""with {_STTM_ALL} select tool, count(*) as mappings, count(*) filter (where is_pk = 'Y') as pk_columns,
        count(*) filter (where transformation_type = 'DIRECT') as direct,
        count(*) filter (where transformation_type not in ('DIRECT', 'NONE')) as transformed from sttm group by 1""",
    "sttm_short_classes": f"""with {_STTM} select tool, case when expression is null or expression in ('', 'DIRECT') or expression = source_column then 'DIRECT'
        when contains(upper(expression), 'MD5') or contains(upper(expression), 'SHA') then 'HASH' else 'EXPRESSION' end as expression_class,
        count(*) as mappings from sttm where target_table <> '{mapping.UNMAPPED}' group by 1, 2""",
    "sttm_sheet": f"""with {_CAT}, s as (select source_table, target_column, case when expression = '' then 'DIRECT' else expression end as expression,
          case when expression in ('', 'DIRECT') or expression = source_column then 'DIRECT'
               when contains(upper(expression), 'MD5') or contains(upper(expression), 'SHA') then 'HASH' else 'EXPRESSION' end as transformation_type,
          case when {_words('lower(target_column)', mapping.PII_WORDS_SHEET)} then 'PII' else '' end as pii_flag from maps)
        select *, count(*) as mappings from s group by all""",
    "sttm_loads": f"""with {_CAT}, k as (select table_name, column_name, max(key_type = 'PRIMARY KEY') as pk from cat group by all),
        c as (select source_table, target_table, tool, case when cast(right(target_table, 1) as int) % 2 = 0 then 'INCREMENTAL' else 'FULL' end as load_strategy,
                pk, {_CLASS.replace('{e}', 'expression')} = 'DIRECT' as direct
              from maps left join k on table_name = source_table and column_name = source_column)
        select tool, load_strategy, count(distinct (source_table, target_table)) as mappings, count(*) as columns, count(*) filter (where pk) as pk_columns,
               count(*) filter (where direct) as direct, count(*) filter (where not direct) as transformed from c group by cube (tool, load_strategy)""",
    "sttm_unmapped": f"with {_STTM} select source_table, source_column, is_pk, is_fk, pii_flag from sttm where target_table = '{mapping.UNMAPPED}'",
    "sttm_personal": f"""with {_STTM} select source_table, count(*) as pii_mappings from sttm
        where target_table <> '{mapping.UNMAPPED}' and pii_flag = 'Y' group by 1""",
    "sttm_apply": f"""
        select md5(cast(c_custkey as varchar)) as CUSTOMER_HK, c_custkey as CUSTOMER_BK, trim(c_name || ' ' || c_mktsegment) as FULL_NAME,
               lower(c_name) as NAME_LOWER, upper(c_mktsegment) as SEGMENT, coalesce(c_nationkey, 0) as NATION,
               case when c_acctbal < 0 then 'Y' else 'N' end as IN_DEBT, 'CRM' as RECORD_SOURCE, '{LOAD_DATE}' as LOAD_DATE from customer""",
    "model_business_keys": f"with {_KEYS} select tool, table_name, entity, array_to_string(k, ',') as business_keys from bk",
    "model_primary_keys": f"with {_PRIMARY} select table_name, array_to_string(k, ',') as business_keys from bk",
    "model_hubs": f"""with {_KEYS}, {_HUBS} select 'HUB_' || entity as hub_name, entity, f[1] as source_table, entity || '_HK' as hash_key,
        array_to_string(f[2], ',') as business_keys, 'LOAD_DATE' as ldts, 'RECORD_SOURCE' as rsrc, 'md5' as hash_algorithm from hubs""",
    "model_links": f"""with {_CAT}, {_LINKS} select 'LNK_' || a || '_' || b as link_name, a as entity_a, b as entity_b, 'LNK_' || a || '_' || b || '_HK' as hash_key,
        a || '_HK' as hub_a_hk, b || '_HK' as hub_b_hk, 'LOAD_DATE' as ldts, 'RECORD_SOURCE' as rsrc, 'md5' as hash_algorithm from lp""",
    "model_key_pair_links": f"""with {_KEYS}, x as (select table_name, replace(replace(k[1], '_ID', ''), '_KEY', '') as a, replace(replace(k[2], '_ID', ''), '_KEY', '') as b
        from bk where len(k) >= 2) select 'LNK_' || a || '_' || b as table_name, table_name as source_table, 'HK_' || a || ',HK_' || b as fk_hash_keys from x""",
    "model_satellites": f"""with {_KEYS}, s as (
        select cat.tool, cat.table_name, entity, string_agg(column_name || ':' || {_TYPE} || ':' || case when {_words('lower(column_name)', mapping.PII_WORDS_VAULT)} then 'true' else 'false' end, ','
                 order by ordinal, column_name, data_type, nullable) as attributes
        from cat join bk on bk.tool = cat.tool and bk.table_name = cat.table_name where not list_contains(k, column_name) group by all)
        select 'SAT_' || entity || '_' || regexp_replace(table_name, '^SRC_', '') as sat_name, table_name as source_table, entity || '_HK' as hub_hash_key,
               entity || '_' || regexp_replace(table_name, '^SRC_', '') || '_HASHDIFF' as hashdiff, attributes from s""",
    "model_relationships": f"""with {_CAT}, n as (select distinct table_name from cat),
        f as (select distinct table_name, replace(column_name, '_ID', '') as stem from cat where column_name like '%\\_ID' escape '\\' and not contains(key_type, 'PRIMARY'))
        select distinct n.table_name as parent, f.table_name as child from f join n on contains(n.table_name, stem)""",
    "model_relationship_ends": f"""with {_CAT}, n as (select distinct table_name from cat),
        f as (select distinct table_name, replace(column_name, '_ID', '') as stem from cat where column_name like '%\\_ID' escape '\\' and not contains(key_type, 'PRIMARY')),
        p as (select f.table_name as child, stem, n.table_name as parent from f join n on contains(n.table_name, stem))
        select stem, 'child' as role, child as table_name, count(distinct parent) as n_linked from p group by stem, child
        union all select stem, 'parent', parent, count(distinct child) from p group by stem, parent""",
    "dq_rules": f"""with {_RULES} select 'DQ_' || p || '_' || case when n < 10000 then lpad(cast(n as varchar), 4, '0') else cast(n as varchar) end as rule_id,
        dimension, t as "table", c as "column", k as check_type, rule from rn""",
    "dq_dimensions": f"""with {_RULES}, d(dimension, description) as (values {", ".join(f"('{k}', '{v}')" for k, v in quality.DIMENSIONS.items())})
        select d.dimension, d.description, count(rn.dimension) as n_rules from d left join rn on rn.dimension = d.dimension group by 1, 2""",
    "dq_column_rules": f"""with {_COLUMN_RULES} select table_name, ordinal, target_column, array_to_string(l, ',') as dq_rules, cast(len(l) as int) as n_rules, is_critical from cr""",
    "dq_rule_counts": f"""with {_COLUMN_RULES} select count(*) as total_columns, count(*) filter (where len(l) > 0) as columns_with_rules,
        count(*) filter (where is_critical) as critical_columns, cast(sum(len(l)) as bigint) as total_rules from cr""",
}
