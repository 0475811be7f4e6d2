"""Signature scans of documents, pages and the scripts derived from parts and suppliers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from etlvault.operators import scan
from etlvault.sources import artifacts
from etlvault.workload import catalog_queries, derived
from etlvault.workload.tables import table, wide

# One script per supplier, by its nation: (last nation key, extension, text around the supplier's name).
TEMPLATES = [
    (2, ".bteq", ".LOGON prod\nBTEQ\nSELECT c FROM stage.{n} JOIN core.{n} ON 1=1;\nCOLLECT STATISTICS ON {n};\nCREATE MACRO m;"),
    (5, ".sql", "CREATE OR REPLACE PROCEDURE p_{n} AS\nBEGIN\n INSERT INTO dw.{n} SELECT NVL(a, 0), SYSDATE FROM src.{n};\n CALL p_log(1);\nEND;"),
    (8, ".jcl", "//LOAD{n} JOB (ACCT)\n//STEP1 EXEC PGM=SORT\n//IN DD DSNAME=PROD.{n},RECFM=FB,LRECL=80\n 01 REC PIC X(10).\nCOPY CUST{n}"),
    (11, ".sql", "SELECT TOP 10 * FROM [dbo].{n} WITH (NOLOCK) WHERE GETDATE() > d;\nEXEC usp_{n};\nEXEC usp_{n};\n-- nightly batch schedule"),
    (14, ".yaml", "openapi: 3.0\npaths:\n  GET /v1/{n}\n  POST /v1/{n}\nsecurity: OAuth Bearer token\nformat = JSON"),
    (17, ".sql", "-- kafka topic {n}, change data capture\nCREATE EXTERNAL TABLE ext_{n} LOCATION = 's3' FORMAT = AVRO;\nSELECT f_{n}(x) FROM V_{n};"),
    (20, ".sql", "-- refresh every 5 minutes, micro-batch\nCREATE VIEW v_{n} AS SELECT a FROM ods.{n};\nNZLOAD -t {n};\nUPDATE \"{n}\" SET b = NEXTVAL;"),
    (99, ".txt", "name,delimiter = ',' field_delimiter\nblob column, for xml path\npositional record layout\nreport_{n}.csv"),
]


def legacy_scripts(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    name, ext, body = F.concat(F.lit("S"), F.col("s_suppkey").cast("string")), F, F
    for last, suffix, text in TEMPLATES:
        test = F.col("s_nationkey") <= last
        ext, body = ext.when(test, suffix), body.when(test, F.replace(F.lit(text), F.lit("{n}"), name))
    return s.select(F.concat(F.lit("legacy/"), name, ext).alias("path"), body.alias("content"))


def corpus(spark, sf_dir) -> DataFrame:
    documents = wide(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("content"))
    pages = wide(spark, sf_dir, "pages").select(
        F.concat(F.lit("page/"), F.col("page_id").cast("string"), F.lit(".xml")).alias("path"), F.col("html").alias("content"))
    scripts = catalog_queries.scripts(spark, sf_dir).select(F.concat(F.lit("ddl/"), "path").alias("path"), "content")
    return documents.unionByName(pages).unionByName(scripts).unionByName(legacy_scripts(spark, sf_dir))


def _joined(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.array_join(n, ",") for n in names})


def scan_labels(spark, sf_dir):
    found = scan.scan(corpus(spark, sf_dir))
    return _joined(found.select("path", "filename", "extension", F.col("size_bytes").cast("bigint").alias("size_bytes"),
                                "platforms", "formats", "patterns"), "platforms", "formats", "patterns")


def scan_complexity(spark, sf_dir):
    return scan.scan(corpus(spark, sf_dir)).select("path", "total_objects", "complexity_score", "complexity_level")


def scan_summary(spark, sf_dir):
    return scan.label_counts(scan.scan(corpus(spark, sf_dir)))


def scan_object_types(spark, sf_dir):
    return scan.object_type_counts(scan.scan(corpus(spark, sf_dir)))


def scan_objects(spark, sf_dir):
    return scan.objects(corpus(spark, sf_dir))


def scan_top_objects(spark, sf_dir):
    return scan.top_objects(scan.objects(corpus(spark, sf_dir)))


def scan_frequent(spark, sf_dir):
    return scan.frequent_objects(scan.objects(corpus(spark, sf_dir)))


def scan_priority(spark, sf_dir):
    return scan.prioritise(scan.scan(corpus(spark, sf_dir))).select("path", "complexity_level", "priority_score")


def scan_routes(spark, sf_dir):
    files = (corpus(spark, sf_dir).unionByName(catalog_queries.job_exports(spark, sf_dir))
             .unionByName(catalog_queries.mapping_exports(spark, sf_dir).withColumn("path", F.concat(F.lit("informatica_"), "path"))))
    return artifacts.route(files).groupBy("tool", "harvestable").agg(F.count("*").alias("files"))


def scan_recommendations(spark, sf_dir):
    return scan.unique_recommendations(scan.recommendations(scan.scan(corpus(spark, sf_dir), frequent=3)))


QUERIES = {
    "scan_labels": scan_labels, "scan_complexity": scan_complexity, "scan_summary": scan_summary, "scan_object_types": scan_object_types,
    "scan_objects": scan_objects, "scan_top_objects": scan_top_objects, "scan_frequent": scan_frequent, "scan_priority": scan_priority,
    "scan_routes": scan_routes, "scan_recommendations": scan_recommendations,
}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _re2(pattern: str) -> str:
    """The pattern for the SQL engine: letters of other scripts are replaced there, so plain word classes do."""
    return _q("(?i)" + re.sub(r"\$$", r"\\n?$", pattern))


_LEGACY_EXT = "case " + " ".join(f"when s_nationkey <= {n} then '{e}'" for n, e, _ in TEMPLATES) + " end"
_LEGACY_TEXT = "case " + " ".join(f"when s_nationkey <= {n} then replace({_q(t)}, '{{n}}', 'S' || s_suppkey)" for n, _, t in TEMPLATES) + " end"

_CORPUS = f"""
{derived.CATALOG_SQL},
body as (
  select table_name, string_agg('  ' || column_name || ' ' || data_type || case when nullable then '' else ' NOT NULL' end ||
         case key_type when 'PRIMARY KEY' then ' PRIMARY KEY' when 'FOREIGN KEY' then ' REFERENCES X' else '' end, ',' || chr(10)
         order by ordinal) as b from cat group by 1),
files as (
  select 'doc/' || doc_id || '.txt' as path, text as content from documents
  union all select 'page/' || page_id || '.xml', html from pages
  union all select 'ddl/' || table_name || '.sql', '-- load of ' || table_name || chr(10) || '/* CREATE TABLE old (x INT); */' || chr(10) || 'CREATE TABLE ' || table_name
         || ' (' || chr(10) || b || chr(10) || ');' || chr(10) || 'INSERT INTO TGT_' || table_name || ' (K, V)' || chr(10) || 'SELECT MD5(CAST(ID AS VARCHAR)), NVL(V, 0)'
         || chr(10) || 'FROM ' || table_name || ' WHERE V > 0;' || chr(10) || 'CREATE VIEW V_' || table_name || ' AS' || chr(10) || 'SELECT K, V FROM ' || table_name || ';' from body
  union all select 'legacy/S' || s_suppkey || {_LEGACY_EXT}, {_LEGACY_TEXT} from supplier),
t as (select path, content, regexp_extract(path, '(\\.[^./]*)$', 1) as ext,
        regexp_replace(regexp_replace(content, '[^\\x00-\\x7F\\p{{L}}\\p{{N}}]', ' ', 'g'), '[^\\x00-\\x7F]', 'q', 'g') as c from files)"""


def _label_sql(signatures, default, hints=None) -> str:
    tests = []
    for label, patterns in signatures.items():
        options = [f"regexp_matches(c, {_re2(p)})" for p in patterns]
        options += [f"ext = '{e}'" for e, p in (hints or {}).items() if p == label]
        tests.append(f"case when {' or '.join(options)} then '{label}' end")
    return f"coalesce(nullif([x for x in [{', '.join(tests)}] if x is not null], []), ['{default}'])"


def _names_sql(kind: str) -> str:
    parts = []
    for p in scan.OBJECT_SIGNATURES[kind]:
        group = 1 if re.search(r"(?<!\\)\((?!\?)", p) else 0
        parts.append(f"regexp_extract_all(c, {_re2(p)}, {group})")
    joined = f"[x for x in [trim(y, chr(10) || chr(13) || chr(9) || ' ') for y in flatten([{', '.join(parts)}])] if x <> '']"
    if kind == "table":
        joined = f"list_concat({joined}, [x for x in [trim(y, '\"') for y in regexp_extract_all(c, {_re2(scan.TABLE_REFERENCE)}, 1)] if length(x) > 1])"
    if kind == "stored_procedure":
        joined = f"list_concat({joined}, regexp_extract_all(c, {_re2(scan.CALL_REFERENCE)}, 1))"
    return joined


_LABELS = f"""
lab as (select path, c, content, ext, {_label_sql(scan.PLATFORM_SIGNATURES, 'unknown', scan.EXTENSION_PLATFORMS)} as platforms,
          {_label_sql(scan.FORMAT_SIGNATURES, 'unknown')} as formats, {_label_sql(scan.MOVEMENT_SIGNATURES, 'batch')} as patterns from t)"""
_OBJECTS = "obj as (" + " union all ".join(
    f"select path, '{k}' as object_type, unnest({_names_sql(k)}) as name from t" for k in scan.OBJECT_SIGNATURES) + """),
freq as (select path, object_type, name, count(*) as frequency from obj group by all)"""
_WEIGHT = "case object_type " + " ".join(f"when '{k}' then {w}" for k, w in scan.WEIGHTS.items()) + " else 3 end"
_SCORED = f"""
cnt as (select path, count(*) as n, sum({_WEIGHT}) as base from freq group by 1),
sc as (select lab.*, cast(coalesce(n, 0) as int) as total_objects,
         cast(least(100, greatest(1, floor((coalesce(base, 0) * (case when list_contains(patterns, 'realtime') then 1.8::double
              when list_contains(patterns, 'near_realtime') then 1.4::double else 1.0::double end)
              + 15 * len([x for x in formats if x in ('blob', 'xml', 'fixed_width', 'avro')])) / 5))) as int) as score
       from lab left join cnt on cnt.path = lab.path),
lv as (select *, case when score >= 70 then 'HIGH' when score >= 40 then 'MEDIUM' else 'LOW' end as level from sc)"""
_FULL = f"{_CORPUS}, {_LABELS}, {_OBJECTS}, {_SCORED}"
_ADVICE = "adv as (" + " union all ".join(
    f"select '{k}' as kind, '{label}' as label, {_q(t)} as r" for (k, label), ts in scan.ADVICE.items() for t in ts) + ")"
_RANKED = """rk as (select *, row_number() over (partition by path, object_type order by frequency desc, name) as rn from freq),
fr as (select * from rk where rn <= 3 and frequency > 1)"""

ORACLE = {
    "scan_labels": f"""with {_CORPUS}, {_LABELS} select path, regexp_extract(path, '[^/]*$') as filename, lower(ext) as extension,
        cast(octet_length(encode(content)) as bigint) as size_bytes, array_to_string(platforms, ',') as platforms,
        array_to_string(formats, ',') as formats, array_to_string(patterns, ',') as patterns from lab""",
    "scan_complexity": f"with {_FULL} select path, total_objects, score as complexity_score, level as complexity_level from lv",
    "scan_summary": f"""with {_FULL}, l as (
        select 'platform' as kind, unnest(platforms) as label from lv union all select 'pattern', unnest(patterns) from lv
        union all select 'format', unnest(formats) from lv union all select 'complexity', level from lv)
        select kind, label, count(*) as files from l group by all""",
    "scan_object_types": f"with {_CORPUS}, {_OBJECTS} select object_type, count(*) as objects from freq group by 1",
    "scan_objects": f"with {_CORPUS}, {_OBJECTS} select * from freq",
    "scan_top_objects": f"""with {_CORPUS}, {_OBJECTS}, s as (select object_type, name, cast(sum(frequency) as bigint) as total_frequency from freq group by all),
        r as (select *, cast(row_number() over (partition by object_type order by total_frequency desc, name) as int) as rank from s)
        select * from r where rank <= 10""",
    "scan_frequent": f"with {_CORPUS}, {_OBJECTS}, {_RANKED} select path, object_type, name, frequency from fr",
    "scan_priority": f"""with {_FULL} select path, level as complexity_level, cast(score + case when list_contains(patterns, 'realtime') then 40
        when list_contains(patterns, 'near_realtime') then 20 else 0 end as int) as priority_score from lv""",
    "scan_routes": f"""with {_CORPUS}, n as (select count(distinct table_name) as k from cat)
        select tool, tool is not null as harvestable, files from (
          select cast(null as varchar) as tool, count(*) as files from files union all select 'job_export', k from n union all select 'mapping_export', k from n)""",
    "scan_recommendations": f"""with {_FULL}, {_ADVICE}, {_RANKED}, rec as (
        select r from lv join adv on kind = 'platform' and label = platforms[1]
        union all select r from (select unnest(patterns) as l from lv) join adv on kind = 'pattern' and label = l
        union all select r from (select unnest(formats) as l from lv) join adv on kind = 'format' and label = l
        union all select 'Start with the frequent ' || object_type || 's: ' || string_agg(name, ', ' order by name) from fr group by path, object_type)
        select min(r) as recommendation, count(*) as files from rec group by left(r, 60)""",
}
