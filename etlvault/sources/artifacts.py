"""Metadata harvest: job exports, mapping exports, replication tasks and scripts as catalogs.

Every harvester takes files as rows ``(path, content)`` and works on all of them at once
with the built-in XML, JSON and regular-expression functions under explicit schemas, so
single and repeated children read alike. A malformed file yields no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from etlvault.operators.ordered import first_by

# Extensions of a scan, and stage-type words that decide a stage's role.
SCRIPT_EXTENSIONS = (".sql", ".ddl", ".bteq", ".jcl", ".cbl", ".cob", ".yaml", ".yml", ".json", ".xml", ".txt",
                     ".proc", ".pkb", ".pks", ".fnc", ".trg", ".vw")
SOURCE_WORDS = ("source", "seq", "odbc", "db2", "oracle", "jdbc")
TARGET_WORDS = ("target", "sink", "write")
TRANSFORM_WORDS = ("transform", "filter", "aggregat", "join", "lookup", "sort")
FALSE_WORDS = ("N", "NO", "FALSE", "0", "NOT NULL")


class Catalogs(NamedTuple):
    """What a harvest gives: columns, column mappings, transformations and views."""

    columns: DataFrame
    mappings: DataFrame
    transforms: DataFrame
    views: DataFrame


COLUMN_FIELDS = {"tool": "string", "source_file": "string", "job": "string", "position": "bigint", "table_name": "string",
                 "schema_name": "string", "role": "string", "ordinal": "int", "column_name": "string",
                 "data_type": "string", "length": "string", "nullable": "boolean", "key_type": "string", "expression": "string"}
MAPPING_FIELDS = {"tool": "string", "source_file": "string", "job": "string", "ordinal": "bigint", "source_table": "string",
                  "source_column": "string", "target_table": "string", "target_column": "string", "expression": "string"}
TRANSFORM_FIELDS = {"tool": "string", "source_file": "string", "job": "string", "ordinal": "bigint", "name": "string",
                    "type": "string", "field": "string", "expression": "string", "data_type": "string"}
VIEW_FIELDS = {"tool": "string", "source_file": "string", "name": "string", "schema_name": "string", "sql": "string"}


def _shape(df: DataFrame, fields: dict[str, str], **values: Column | str | int | bool) -> DataFrame:
    made = []
    for name, kind in fields.items():
        v = values.get(name, F.lit(None) if kind == "boolean" else F.lit("" if kind == "string" else 0))
        made.append((v if isinstance(v, Column) else F.lit(v)).cast(kind).alias(name))
    return df.select(*made)


def _none(spark: SparkSession, fields: dict[str, str]) -> DataFrame:
    return spark.createDataFrame([], ", ".join(f"{n} {k}" for n, k in fields.items()))


def read_files(spark: SparkSession, path: str | Sequence[str], extensions: Sequence[str] | None = None,
               recursive: bool = True) -> DataFrame:
    """Files as rows ``(path, content)``, whole texts, optionally by extension in any case."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=recursive).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    if extensions is None:
        return files
    return files.filter(extension(F.col("path")).isin([e.lower() for e in extensions]))


def corpus(spark: SparkSession, path: str, extensions: Sequence[str] = SCRIPT_EXTENSIONS, recursive: bool = True) -> DataFrame:
    """All script files under a folder."""
    return read_files(spark, path, extensions, recursive)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot, or the empty string."""
    return F.lower(F.regexp_extract(file_name(path), r"(\.[^.]*)$", 1))


def route(files: DataFrame) -> DataFrame:
    """Which harvester can read a file directly, by name; all others need custom handling."""
    ext, name = extension(F.col("path")), F.lower(file_name(F.col("path")))
    tool = F.when(ext.isin(".dsx", ".ipc") | name.contains("datastage"), F.lit("job_export")).when(
        (ext == ".xml") & name.contains("informatica"), F.lit("mapping_export"))
    return files.withColumn("tool", tool).withColumn("harvestable", tool.isNotNull()).withColumn(
        "needs_custom_parser", F.lit(True))


def is_nullable(flag: Column) -> Column:
    return ~F.upper(F.trim(F.coalesce(flag, F.lit("")))).isin(*FALSE_WORDS)


def _any_word(text: Column, words: Sequence[str]) -> Column:
    return reduce(Column.__or__, [text.contains(w) for w in words])


def _first(*options: Column) -> Column:
    """First non-empty value, else the empty string."""
    return F.coalesce(*[F.nullif(o, F.lit("")) for o in options], F.lit(""))


def _place(outer: str, inner: str) -> Column:
    """One number that orders by two positions, each of which has 31 bits."""
    return F.shiftleft(F.col(outer).cast("bigint"), 31) + F.col(inner)


def _joined(*arrays: Column, kind: str) -> Column:
    return F.concat(*[F.coalesce(a, F.array().cast(kind)) for a in arrays])


# ---------------------------------------------------------------- job exports (XML)

_COL = "STRUCT<_Identifier: STRING, _Name: STRING, _SqlType: STRING, _DataType: STRING, _data_type: STRING, _Type: STRING, " \
       "_Length: STRING, _Nullable: STRING, _Derivation: STRING, _Expression: STRING>"
_PROP = "STRUCT<_Name: STRING, _Value: STRING, body: STRING>"
_CLAUSE = "STRUCT<_Value: STRING, body: STRING>"
_STAGE = f"STRUCT<_Identifier: STRING, _Name: STRING, _StageType: STRING, _Type: STRING, _TableName: STRING, _table_name: STRING, " \
         f"_SourceTable: STRING, _TargetTable: STRING, Properties: STRUCT<Property: ARRAY<{_PROP}>>, Property: ARRAY<{_PROP}>, " \
         f"Column: ARRAY<{_COL}>, DSColumn: ARRAY<{_COL}>, Columns: STRUCT<Column: ARRAY<{_COL}>>, " \
         f"Clause: ARRAY<{_CLAUSE}>, Expression: ARRAY<{_CLAUSE}>>"
_LINK = f"STRUCT<_SourceStage: STRING, _source_stage: STRING, _TargetStage: STRING, _target_stage: STRING, " \
        f"Column: ARRAY<{_COL}>, DSColumn: ARRAY<{_COL}>, Columns: STRUCT<Column: ARRAY<{_COL}>>>"
_JOB_BODY = f"_Identifier: STRING, _Name: STRING, Stage: ARRAY<{_STAGE}>, DSStage: ARRAY<{_STAGE}>, Link: ARRAY<{_LINK}>, DSLink: ARRAY<{_LINK}>"
_JOB = f"STRUCT<{_JOB_BODY}>"
_ATTRIBUTES = r"""(?:[^<>"']++|"[^"]*+"|'[^']*+')*+"""
_COLUMN_TAG = rf"<(?:DS)?Column\b{_ATTRIBUTES}>"
_XML = {"valueTag": "body", "mode": "PERMISSIVE"}


def _columns_of(node: str) -> Column:
    return _joined(F.col(f"{node}.Column"), F.col(f"{node}.DSColumn"), kind=f"ARRAY<{_COL}>")


def _blocks(column: str, *names: str) -> Column:
    """Elements of the given names, at any level, as text."""
    return F.regexp_extract_all(F.col(column), F.lit(rf"(?s)<({'|'.join(names)})\b{_ATTRIBUTES}(?:(?<=/)>|>.*?</\1\s*+>)"), F.lit(0))


def _parsed(blocks: Column, name: str, schema: str) -> Column:
    """The elements parsed, with the columns of all their levels right below them."""
    def flat(block: Column) -> Column:
        head = F.regexp_replace(F.regexp_extract(block, rf"^<\w+{_ATTRIBUTES}>", 0), r"^<\w+|\s*/?>$", "")
        body = F.regexp_replace(F.regexp_replace(block, rf"(?s)^<\w+{_ATTRIBUTES}>|</\w+\s*+>$", ""), rf"{_COLUMN_TAG}|</(?:DS)?Column\s*+>", "")
        columns = F.transform(F.regexp_extract_all(block, F.lit(_COLUMN_TAG), F.lit(0)), lambda c: F.regexp_replace(c, r"\s*/?>$", "/>"))
        return F.concat(F.lit(f"<{name}"), head, F.lit(">"), body, F.array_join(columns, ""), F.lit(f"</{name}>"))

    return F.from_xml(F.concat(F.lit("<all>"), F.array_join(F.transform(blocks, flat), ""), F.lit("</all>")), f"{name} ARRAY<{schema}>", _XML)[name]


def harvest_jobs(files: DataFrame, stage_type_only: bool = False) -> Catalogs:
    """Job exports: stages as source, target or transformation, links as column mappings.

    A stage that only receives links is a target whatever its type says, since file
    stages carry the same type on both ends; ``stage_type_only`` decides by type alone.
    """
    tool = "job_export"
    whole = files.filter(F.from_xml("content", "_version STRING", _XML).isNotNull())
    blocks = whole.select("path", _blocks("content", "Job", "DSJob", "DSExportedObject").alias("b"), F.col("content"))
    texts = blocks.select("path", F.posexplode(F.when(F.size("b") > 0, F.col("b")).otherwise(F.array("content"))).alias("at", "t"))
    jobs = (
        texts.select("path", "at", F.from_xml("t", "_Identifier STRING, _Name STRING", _XML).alias("j"),
                     _parsed(_blocks("t", "Stage", "DSStage"), "Stage", _STAGE).alias("stages"), _parsed(_blocks("t", "Link", "DSLink"), "Link", _LINK).alias("links"))
        .select("path", _first(F.col("j._Identifier"), F.col("j._Name"), F.lit("UNKNOWN_JOB")).alias("job"), "stages", "links")
        .withColumn("feeds", F.transform("links", lambda k: F.coalesce(k["_SourceStage"], k["_source_stage"])))
        .withColumn("fed", F.transform("links", lambda k: F.coalesce(k["_TargetStage"], k["_target_stage"])))
    )
    stages = jobs.select("path", "job", "feeds", "fed", F.posexplode("stages").alias("position", "s")).select(
        "path", "job", "position", "s", "feeds", "fed",
        F.lower(_first(F.col("s._StageType"), F.col("s._Type"))).alias("kind"),
        _first(F.col("s._Identifier"), F.col("s._Name"), F.lit("UNKNOWN_STAGE")).alias("name"))
    only_fed = F.coalesce(F.array_contains("fed", F.col("name")) & ~F.array_contains("feeds", F.col("name")), F.lit(False))
    is_source, is_target = _any_word(F.col("kind"), SOURCE_WORDS), _any_word(F.col("kind"), TARGET_WORDS)
    role = F.when(is_source, F.lit("source")).when(is_target, F.lit("target")).when(
        _any_word(F.col("kind"), TRANSFORM_WORDS), F.lit("transform"))
    if not stage_type_only:
        role = F.when((is_source | is_target) & only_fed, F.lit("target")).otherwise(role)
    named = F.filter(_joined(F.col("s.Property"), F.col("s.Properties.Property"), kind=f"ARRAY<{_PROP}>"),
                     lambda p: p["_Name"] == "TableName")
    prop = F.get(named, F.lit(0))
    table = _first(F.col("s._TableName"), F.col("s._table_name"), F.col("s._SourceTable"), F.col("s._TargetTable"),
                   F.trim(prop["body"]), prop["_Value"], F.col("name"))
    placed = stages.withColumn("role", role).withColumn("table_name", table)

    cells = placed.filter(F.col("role").isin("source", "target")).select(
        "path", "job", "position", "role", "table_name", F.posexplode(_columns_of("s")).alias("ordinal", "c"))
    columns = _shape(cells, COLUMN_FIELDS, tool=tool, source_file=F.col("path"), job=F.col("job"), position=F.col("position"),
                     table_name=F.col("table_name"), role=F.col("role"), ordinal=F.col("ordinal"),
                     column_name=_first(F.col("c._Identifier"), F.col("c._Name")),
                     data_type=_first(F.col("c._SqlType"), F.col("c._DataType"), F.col("c._data_type"), F.col("c._Type"), F.lit("VARCHAR")),
                     length=F.coalesce("c._Length", F.lit("")), nullable=is_nullable(F.col("c._Nullable")),
                     expression=_first(F.col("c._Derivation"), F.col("c._Expression")))

    clauses = placed.filter(F.col("role") == "transform").select(
        "path", "job", "name", "kind",
        F.posexplode(_joined(F.col("s.Clause"), F.col("s.Expression"), kind=f"ARRAY<{_CLAUSE}>")).alias("ordinal", "e"))
    clauses = clauses.withColumn("text", F.trim(_first(F.col("e._Value"), F.col("e.body")))).filter("text <> ''")
    transforms = _shape(clauses, TRANSFORM_FIELDS, tool=tool, source_file=F.col("path"), job=F.col("job"), ordinal=F.col("ordinal"),
                        name=F.col("name"), type=F.col("kind"), expression=F.col("text"))

    links = jobs.select("path", "job", F.posexplode("links").alias("p", "k"))
    moved = links.select("path", "job", "p", F.col("k._SourceStage").alias("a1"), F.col("k._source_stage").alias("a2"),
                         F.col("k._TargetStage").alias("b1"), F.col("k._target_stage").alias("b2"),
                         F.posexplode(_columns_of("k")).alias("q", "c"))
    column = _first(F.col("c._Identifier"), F.col("c._Name"))
    mappings = _shape(moved, MAPPING_FIELDS, tool=tool, source_file=F.col("path"), job=F.col("job"),
                      ordinal=_place("p", "q"), source_table=_first(F.col("a1"), F.col("a2")), source_column=column,
                      target_table=_first(F.col("b1"), F.col("b2")), target_column=column,
                      expression=_first(F.col("c._Derivation"), F.col("c._Expression")))
    return Catalogs(columns, mappings, transforms, _none(files.sparkSession, VIEW_FIELDS))


# ------------------------------------------------------------ mapping exports (XML)

_FIELD = "STRUCT<_NAME: STRING, _DATATYPE: STRING, _LENGTH: STRING, _NULLABLE: STRING, _KEYTYPE: STRING>"
_SRC = f"STRUCT<_NAME: STRING, _DBDNAME: STRING, _SCHEMANAME: STRING, SOURCEFIELD: ARRAY<{_FIELD}>>"
_TGT = f"STRUCT<_NAME: STRING, _DBDNAME: STRING, _SCHEMANAME: STRING, TARGETFIELD: ARRAY<{_FIELD}>>"
_PORT = "STRUCT<_NAME: STRING, _DATATYPE: STRING, _EXPRESSION: STRING, _DEFAULTVALUE: STRING>"
_STEP = f"STRUCT<_NAME: STRING, _TYPE: STRING, TRANSFORMFIELD: ARRAY<{_PORT}>>"
_WIRE = "STRUCT<_FROMINSTANCE: STRING, _FROMFIELD: STRING, _TOINSTANCE: STRING, _TOFIELD: STRING>"
_MAP = f"STRUCT<_NAME: STRING, SOURCE: ARRAY<{_SRC}>, TARGET: ARRAY<{_TGT}>, TRANSFORMATION: ARRAY<{_STEP}>, CONNECTOR: ARRAY<{_WIRE}>>"
_FOLDER_BODY = f"SOURCE: ARRAY<{_SRC}>, TARGET: ARRAY<{_TGT}>, MAPPING: ARRAY<{_MAP}>"
_MART = f"STRUCT<REPOSITORY: ARRAY<STRUCT<FOLDER: ARRAY<STRUCT<{_FOLDER_BODY}>>>>, FOLDER: ARRAY<STRUCT<{_FOLDER_BODY}>>, {_FOLDER_BODY}>"


def harvest_mappings(files: DataFrame) -> Catalogs:
    """Mapping exports: source and target definitions, expression ports and connectors."""
    tool = "mapping_export"
    parsed = files.select("path", F.from_xml("content", _MART, _XML).alias("x")).filter("x IS NOT NULL")
    nested = F.flatten(F.transform("x.REPOSITORY", lambda r: r["FOLDER"]))
    plain = F.array(F.struct(*[F.col(f"x.{n}").alias(n) for n in ("SOURCE", "TARGET", "MAPPING")]))
    kind = f"ARRAY<STRUCT<{_FOLDER_BODY}>>"
    folders = parsed.select("path", F.posexplode(_joined(nested, F.col("x.FOLDER"), plain, kind=kind)).alias("fp", "f"))

    def tables(node: str, fields: str, role: str, kind: str) -> Column:
        inner = F.flatten(F.transform("f.MAPPING", lambda m: F.coalesce(m[node], F.array().cast(kind))))
        return F.transform(_joined(F.col(f"f.{node}"), inner, kind=kind), lambda t, i: F.struct(
            F.lit(role).alias("role"), i.alias("p"), _first(t["_NAME"], t["_DBDNAME"], F.lit(f"UNKNOWN_{role.upper()}")).alias("table_name"),
            _first(t["_DBDNAME"], t["_SCHEMANAME"]).alias("schema_name"), t[fields].alias("fields")))

    # both roles come from one explode, so that a file is parsed once for its columns
    found = folders.select("path", "fp", F.inline(F.concat(
        tables("SOURCE", "SOURCEFIELD", "source", f"ARRAY<{_SRC}>"), tables("TARGET", "TARGETFIELD", "target", f"ARRAY<{_TGT}>"))))
    cells = found.select("path", _place("fp", "p").alias("p"), "role", "table_name", "schema_name", F.posexplode("fields").alias("ordinal", "c"))
    columns = _shape(cells, COLUMN_FIELDS, tool=tool, source_file=F.col("path"), position=F.col("p"), table_name=F.col("table_name"),
                     schema_name=F.col("schema_name"), role=F.col("role"), ordinal=F.col("ordinal"), column_name=F.coalesce("c._NAME", F.lit("")),
                     data_type=F.coalesce("c._DATATYPE", F.lit("")), length=F.coalesce("c._LENGTH", F.lit("")),
                     nullable=is_nullable(F.col("c._NULLABLE")), key_type=F.coalesce("c._KEYTYPE", F.lit("")))
    maps = folders.select("path", "fp", F.posexplode("f.MAPPING").alias("mp", "m")).withColumn(
        "job", F.coalesce("m._NAME", F.lit("UNKNOWN_MAPPING")))
    at = F.shiftleft(F.col("fp").cast("bigint"), 16) + F.col("mp")
    steps = maps.select("path", "job", at.alias("at"), F.posexplode("m.TRANSFORMATION").alias("sp", "s")).select(
        "path", "job", "at", "sp", "s", F.posexplode("s.TRANSFORMFIELD").alias("pp", "p"))
    steps = steps.withColumn("text", _first(F.col("p._EXPRESSION"), F.col("p._DEFAULTVALUE"))).filter("text <> ''")
    transforms = _shape(steps, TRANSFORM_FIELDS, tool=tool, source_file=F.col("path"), job=F.col("job"),
                        ordinal=F.shiftleft(F.shiftleft("at", 16) + F.col("sp"), 16) + F.col("pp"), name=F.coalesce("s._NAME", F.lit("")),
                        type=F.lower(F.coalesce("s._TYPE", F.lit(""))), field=F.coalesce("p._NAME", F.lit("")),
                        expression=F.col("text"), data_type=F.coalesce("p._DATATYPE", F.lit("")))
    wires = maps.select("path", "job", at.alias("at"), F.posexplode("m.CONNECTOR").alias("wp", "w"))
    mappings = _shape(wires, MAPPING_FIELDS, tool=tool, source_file=F.col("path"), job=F.col("job"),
                      ordinal=F.shiftleft("at", 32) + F.col("wp"), source_table=F.coalesce("w._FROMINSTANCE", F.lit("")),
                      source_column=F.coalesce("w._FROMFIELD", F.lit("")), target_table=F.coalesce("w._TOINSTANCE", F.lit("")),
                      target_column=F.coalesce("w._TOFIELD", F.lit("")))
    return Catalogs(columns, mappings, transforms, _none(files.sparkSession, VIEW_FIELDS))


# ------------------------------------------------------- replication tasks (JSON, XML)

_RULE_COL = "STRUCT<columnName: STRING, column_name: STRING, dataType: STRING, data_type: STRING, isPrimaryKey: STRING, " \
            "nullable: STRING, expression: STRING>"
_RULES = f"ARRAY<STRUCT<tableName: STRING, table_name: STRING, schemaName: STRING, schema_name: STRING, " \
         f"columns: ARRAY<{_RULE_COL}>, columnRules: ARRAY<{_RULE_COL}>>>"
_RULE_KEY = r'"(?:tableRules|table_rules|tables)"\s*+:\s*+(?=\[)'


def _attribute(text: Column, *names: str) -> Column:
    return _first(*[F.regexp_extract(text, rf'^[^>]*?\s{n}\s*=\s*"([^"]*)"', 1) for n in names])


def harvest_replication(files: DataFrame) -> Catalogs:
    """Replication tasks: table rules with their columns, at any JSON level or as XML attributes."""
    tool = "replication"
    trimmed = files.select("path", F.trim("content").alias("doc"))
    # a list of rules begins after its key, however deep; reading it stops where the list ends
    parts = trimmed.filter(F.substring("doc", 1, 1).isin("{", "[")).select("path", F.split("doc", _RULE_KEY).alias("parts")).filter(F.size("parts") > 1)
    lists = parts.select("path", "parts", F.explode(F.sequence(F.lit(2), F.size("parts"))).alias("at")).select(
        "path", "at", F.array_join(F.slice("parts", F.col("at"), F.size("parts")), '"tables":').alias("doc"))
    rules = lists.select("path", "at", F.posexplode(F.from_json("doc", _RULES)).alias("k", "t")).withColumn("p", _place("at", "k"))
    cells = rules.select("path", "p", _first(F.col("t.tableName"), F.col("t.table_name"), F.lit("UNKNOWN")).alias("table_name"),
                         _first(F.col("t.schemaName"), F.col("t.schema_name")).alias("schema_name"),
                         F.posexplode(F.coalesce("t.columns", "t.columnRules")).alias("ordinal", "c"))
    pk = F.lower(F.coalesce("c.isPrimaryKey", F.lit("false"))) == "true"
    from_json = _shape(cells, COLUMN_FIELDS, tool=tool, source_file=F.col("path"), position=F.col("p"), table_name=F.col("table_name"),
                       schema_name=F.col("schema_name"), role="source", ordinal=F.col("ordinal"),
                       column_name=_first(F.col("c.columnName"), F.col("c.column_name")),
                       data_type=_first(F.col("c.dataType"), F.col("c.data_type"), F.lit("VARCHAR")),
                       nullable=is_nullable(F.col("c.nullable")), key_type=F.when(pk, F.lit("PRIMARY KEY")).otherwise(F.lit("")),
                       expression=F.coalesce("c.expression", F.lit("")))

    # tags are told by their attributes alone, so broken markup and tags inside other text count too
    markup = trimmed.filter(~F.substring("doc", 1, 1).isin("{", "["))
    tables = markup.select("path", F.posexplode(F.split("doc", r"(?i)(?=<[^<>]*\s(?:TableName|table_name)\s*=)")).alias("p", "t")).filter(
        F.regexp_like("t", F.lit(r'(?i)^<[^<>]*\s(?:TableName|table_name)\s*=')))
    parts = tables.select("path", "p", _attribute(F.col("t"), "TableName", "table_name").alias("table_name"),
                          _attribute(F.col("t"), "Schema", "schema").alias("schema_name"),
                          F.posexplode(F.regexp_extract_all("t", F.lit(r'<[^<>]*\s(?:ColumnName|column_name)\s*=[^<>]*>'), F.lit(0))).alias("ordinal", "c"))
    c = F.col("c")
    from_xml = _shape(parts, COLUMN_FIELDS, tool=tool, source_file=F.col("path"), position=F.col("p"), table_name=F.col("table_name"),
                      schema_name=F.col("schema_name"), role="source", ordinal=F.col("ordinal"),
                      column_name=_attribute(c, "ColumnName", "column_name"),
                      data_type=_first(_attribute(c, "DataType", "data_type"), F.lit("VARCHAR")),
                      nullable=is_nullable(_attribute(c, "Nullable")),
                      key_type=F.when(F.upper(_attribute(c, "IsPK")) == "Y", F.lit("PRIMARY KEY")).otherwise(F.lit("")),
                      expression=_attribute(c, "Expression"))
    steps = markup.select("path", F.posexplode(F.regexp_extract_all("doc", F.lit(r'<[^<>]*\sExpression\s*=[^<>]*>'), F.lit(0))).alias("p", "e"))
    stated = steps.select("path", "p", _first(_attribute(F.col("e"), "TargetColumn"), F.lit("UNKNOWN")).alias("name"), _attribute(F.col("e"), "Expression").alias("e"))
    # text that is no document: an expression goes with the target column named before the next one
    loose = trimmed.filter((F.substring("doc", 1, 1) != "<") & F.get_json_object("doc", "$").isNull())
    pairs = loose.select("path", F.posexplode(F.split("doc", r'"expression"\s*:')).alias("p", "e")).filter("p > 0").select(
        "path", "p", F.regexp_extract("e", r'"target_column"\s*:\s*"([^"]*)"', 1).alias("name"), F.regexp_extract("e", r'^\s*"([^"]*)"', 1).alias("e")).filter(
        "name <> '' AND e <> ''")
    transforms = _shape(stated.unionByName(pairs), TRANSFORM_FIELDS, tool=tool, source_file=F.col("path"), ordinal=F.col("p"), type="expression",
                        name=F.col("name"), expression=F.col("e"))
    spark = files.sparkSession
    return Catalogs(from_json.unionByName(from_xml), _none(spark, MAPPING_FIELDS), transforms, _none(spark, VIEW_FIELDS))


# ------------------------------------------------------------------------- scripts

_QUOTES = r'[`"\[\]]'
# Quoted text is kept, comments go. Possessive repeats, here and below, run as loops of any length.
_COMMENT = r"""(?s)('[^']*+'|"[^"]*+")|--[^\n]*+|/\*.*?\*/"""
# A script as quoted text, single marks, and the text between them, which starts anew at a statement's first word.
_TOKEN = r"""'[^']*+'|"[^"]*+"|`[^`]*+`|[(),;'"`]|[^'"`(),;]++"""
_FIRST_WORD = r"(?i)(?<![\w.])(?=(?:CREATE|INSERT)\s)"
# The words a statement starts with: names, quoted or not, and parentheses; its head is read from so many.
_PART = r"""(?:`[^`]*+`|"[^"]*+"|\[[^\]]*+\]|\w++)"""
_WORD = rf"{_PART}(?:\s*+\.\s*+{_PART})*+|\S"
_IS_NAME = r"""^[\w`"\[]"""
_HEAD_WORDS = 24
# Words that may stand around what a statement makes.
_MODIFIERS = ("OR", "REPLACE", "GLOBAL", "LOCAL", "TEMP", "TEMPORARY", "EXTERNAL", "TRANSIENT", "VOLATILE", "UNLOGGED", "MATERIALIZED", "RECURSIVE",
              "INTERFACE", "BASE", "FORCE", "SECURE")
_BEFORE_NAME = ("IF", "NOT", "EXISTS", "INTO", "OVERWRITE", "TABLE")
_QUERY = r"(?is)(?<![\w.])(?:SELECT|WITH)\s.*$"
# The kinds of data sources a script can create.
DATA_SOURCES = ("JDBC", "DF", "WS", "CUSTOM", "LDAP", "ODBC", "WEB", "BSON", "JSON", "XML", "ITP", "SAPERP")
_TYPE = r"(?i:\w+(?:\s+(?:PRECISION|VARYING)\b)?(?:\s*\([^)]*\))?(?:\s+WITH(?:OUT)?(?:\s+LOCAL)?\s+TIME\s+ZONE)?)"
_CONSTRAINT = r"(?i)^(PRIMARY|UNIQUE|KEY|INDEX|CONSTRAINT|CHECK)\b"


def _strip(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def _bare(name: Column) -> Column:
    return F.regexp_replace(_strip(name), _QUOTES, "")


def _first_of(words: Column, wanted: Sequence[str]) -> Column:
    """Place, from 1, of the first of some words; 0 without any."""
    at = [F.array_position(words, w) for w in wanted]
    return F.coalesce(F.array_min(F.filter(F.array(*at), lambda p: p > 0)), F.lit(0))


def _heads(statements: DataFrame) -> DataFrame:
    """The statements with ``made`` (TABLE, BASE VIEW, VIEW, SOURCE, INSERT or NULL), ``name`` and whether a list follows it.

    Statements that make nothing stay only for the ``whole`` text beside them. A head is told by its words alone: what is made comes after modifiers, its name after
    words such as IF NOT EXISTS.
    """
    words = F.slice(F.regexp_extract_all(F.left("text", F.lit(4000)), F.lit(_WORD), F.lit(0)), 1, _HEAD_WORDS)

    def kind_at(u: Column) -> Column:
        return F.when(F.get(u, F.lit(0)) == "INSERT", F.lit(1)).otherwise(_first_of(u, ("TABLE", "VIEW", "SOURCE", "DATASOURCE")).cast("int"))

    def made(u: Column, k: Column) -> Column:
        kind, between = F.get(u, k - 1), F.slice(u, 2, F.greatest(k - 2, F.lit(0)))
        source = kind.isin("SOURCE", "DATASOURCE")
        allowed = F.forall(between, lambda w: w.isin(*_MODIFIERS) | (source & w.isin("DATA", *DATA_SOURCES)))
        return F.when(kind == "INSERT", "INSERT").when((F.get(u, F.lit(0)) == "CREATE") & (k > 1) & allowed, F.when(
            source, F.when((kind == "DATASOURCE") | F.array_contains(between, "DATA"), "SOURCE")).when(
            (kind == "VIEW") & F.array_contains(between, "BASE"), "BASE VIEW").otherwise(kind))

    def head(w: Column) -> Column:
        return _let(F.transform(w, F.upper), lambda u: _let(kind_at(u), lambda k: _let(
            # the name is the first word behind what is made that is none of those before a name
            k + 1 + F.coalesce(F.array_position(F.transform(F.slice(u, k + 1, _HEAD_WORDS), lambda x: x.isin(*_BEFORE_NAME)), F.lit(False)).cast("int"), F.lit(0)) - 1,
            lambda n: F.struct(made(u, k).alias("made"), F.get(w, n - 1).alias("name"), (F.get(u, n) == "(").alias("listed")))))

    rows = statements.withColumn("__h", _let(words, head)).select("*", "__h.*").drop("__h")
    named = F.regexp_like("name", F.lit(_IS_NAME))
    rows = rows.withColumns({"made": F.when(named, F.col("made")), "name": F.regexp_replace(_bare(F.col("name")), r"\s*\.\s*", "."),
                             "listed": F.coalesce("listed", F.lit(False))})
    return rows.filter(F.col("made").isNotNull() | F.col("whole").isNotNull())


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _query(text: Column, listed: Column) -> Column:
    """The query of a statement: from its first SELECT or WITH, looked for behind the list that follows its name."""
    behind = F.when(listed, F.regexp_replace(text, r"(?s)^[^(]*+\([^()]*+\)", " ")).otherwise(text)
    return F.regexp_extract(behind, _QUERY, 0)


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))


def _words(text: Column) -> Column:
    """The tokens of a script, those that hold a statement's first word cut before it."""
    return F.flatten(F.transform(_tokens(text), lambda t: F.when(F.regexp_like(t, F.lit("^['\"`]")), F.array(t)).otherwise(F.split(t, _FIRST_WORD))))


def _numbered(words: Column, name: str, first: Column) -> Column:
    """Words as structs (i, t, ``name``); the first one alone carries the value ``first``, so that it is not copied to all."""
    return F.transform(words, lambda t, i: F.struct(i.alias("i"), t.alias("t"), F.when(i == 0, first).alias(name)))


def _ordered(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("i")


def _before(keys: Sequence[str]) -> WindowSpec:
    return _ordered(keys).rowsBetween(Window.unboundedPreceding, -1)


def _opened(keys: Sequence[str]) -> Column:
    """Parentheses opened and not closed before a token of its text."""
    change = F.when(F.col("t") == "(", 1).when(F.col("t") == ")", -1).otherwise(0)
    return F.coalesce(F.sum(change).over(_before(keys)), F.lit(0))


def _so_far(test: Column, keys: Sequence[str]) -> Column:
    """How often ``test`` held before a token of its text."""
    return F.coalesce(F.sum(test.cast("int")).over(_before(keys)), F.lit(0))


def _text(test: Column | None = None) -> Column:
    """Aggregate: the tokens of a group, those with ``test`` alone, laid end to end."""
    token = F.struct("i", "t")
    return _strip(F.array_join(F.sort_array(F.collect_list(token if test is None else F.when(test, token)))["t"], ""))


def _statements(files: DataFrame) -> DataFrame:
    """(path, p, text, closed, whole): the statements of every script, without comments.

    A statement ends at a semicolon outside quotes, or before CREATE or INSERT outside
    parentheses. Tokens are rows, so that long scripts take time in proportion. ``whole`` is
    the text of a ``.vw`` file, beside its first statement.
    """
    content, t = F.col("content"), F.col("t")
    whole = F.when(extension(F.col("path")) == ".vw", _strip(content))
    words = _let(_words(F.regexp_replace(content, _COMMENT, "$1 ")), lambda w: F.when(F.size(w) == 0, F.array(F.lit(""))).otherwise(w))
    rows = files.select("path", F.inline(_numbered(words, "whole", whole)))
    rows = rows.withColumns({"opened": _opened(["path"]), "part": _so_far(t == ";", ["path"])})
    # parentheses count from the last semicolon
    depth = F.col("opened") - F.coalesce(F.last(F.when(t == ";", F.col("opened")), ignorenulls=True).over(_before(["path"])), F.lit(0))
    first = (F.col("depth") <= 0) & F.regexp_like("t", F.lit(r"(?i)^(CREATE|INSERT)\s"))
    rows = rows.withColumn("depth", depth).withColumn("turn", F.sum(first.cast("int")).over(_ordered(["path"])))
    return rows.groupBy("path", "part", "turn").agg(
        F.min("i").alias("p"), _text(t != ";").alias("text"), F.max(t == ";").alias("closed"), F.max("whole").alias("whole"))


def _sources_of_parts(files: DataFrame) -> DataFrame:
    """(path, p, kind, name, names, text): what the parts of tables, views and inserts are read from.

    ``text`` is a statement with a list for tables, and a query else; ``names`` is the list that stands before the query.
    """
    rows, text, made, listed = _heads(_statements(files)), F.col("text"), F.col("made"), F.col("listed")
    table, view = made.isin("TABLE", "BASE VIEW") & listed, (made == "VIEW") & (F.col("asked") != "")
    rows = rows.withColumn("asked", _query(text, listed))
    rows = rows.withColumn("kind", F.when(table, "TABLE").when(view, "VIEW").when((made == "INSERT") & (F.col("asked") != ""), "INSERT"))
    known = F.coalesce(F.max(F.col("kind").isin("TABLE", "VIEW")).over(Window.partitionBy("path")), F.lit(False))
    asked = F.concat("asked", F.when((made == "VIEW") & F.col("closed"), ";").otherwise(""))
    names = F.when(listed, F.split(F.regexp_extract(text, r"(?s)^[^(]*+\(([^()]*+)\)", 1), ","))
    stem = F.regexp_replace(file_name(F.col("path")), r"\.[^.]*$", "")
    found = F.struct(F.col("p"), F.col("kind"), F.col("name"), names.alias("names"), F.when(table, text).otherwise(asked).alias("text"))
    lone = F.struct(F.lit(0).alias("p"), F.lit("VIEW").alias("kind"), stem.alias("name"), F.lit(None).cast("array<string>").alias("names"), F.col("whole").alias("text"))
    rows = rows.withColumn("known", known).select("path", F.inline(F.array_compact(F.array(
        F.when(F.col("kind").isNotNull(), found), F.when(F.col("whole").isNotNull() & ~F.col("known"), lone)))))
    return rows


def _parts(sources: DataFrame) -> DataFrame:
    """(path, p, kind, name, q, item, target, source_table): the parts of lists and of select lists, between their own commas.

    A table's parts are those of its first parenthesised list; a query's lie between its own SELECT and FROM,
    behind common table expressions, and a query without FROM gives none. ``target`` is the name at the part's place in ``names``.
    """
    keys, t, i, depth = ["path", "p", "kind"], F.col("t"), F.col("i"), F.col("depth")
    table, whole = F.col("kind") == "TABLE", Window.partitionBy("path", "p", "kind")
    words = F.when(table, _tokens(F.col("text"))).otherwise(
        F.flatten(F.transform(_tokens(F.col("text")), lambda x: F.split(x, r"(?i)(?<![\w.])(?=(?:FROM|SELECT)\s)"))))
    rows = sources.select(*keys, "name", F.inline(_numbered(words, "names", F.col("names"))))
    # the name after FROM stands in the next tokens, if it is quoted
    rest = F.concat(t, *[F.coalesce(F.lead("t", k).over(_ordered(keys)), F.lit("")) for k in (1, 2, 3)])
    rows = rows.withColumns({"depth": F.greatest(F.lit(0), _opened(keys)), "rest": rest})

    def word(pattern: str) -> Column:
        return (depth == 0) & F.regexp_like("t", F.lit(pattern))

    start = F.min(F.when(F.when(table, (t == "(") & (depth == 0)).otherwise(word(r"(?i)^SELECT\s")), i)).over(whole)
    rows = rows.withColumn("start", F.coalesce(start, F.when(~table, F.lit(0))))
    ends = F.when(table, (t == ")") & (depth == 1)).otherwise(word(r"(?i)^FROM\s") & (i >= F.col("start")))
    comma = (t == ",") & (depth == F.when(table, 1).otherwise(0)) & (i >= F.col("start"))
    rows = rows.withColumns({"end": F.min(F.when(ends, F.struct("i", "rest"))).over(whole), "q": _so_far(comma, keys)})
    end = F.col("end.i")
    inside = F.when(table, (i > F.col("start")) & (end.isNull() | (i < end))).otherwise((i >= F.col("start")) & (i < end))
    own = F.when((i == F.col("start")) & ~table, F.regexp_replace("t", r"(?i)^SELECT\s+", "")).otherwise(t)
    read = F.get(F.regexp_extract_all("end.rest", F.lit(_WORD), F.lit(0)), F.lit(1))
    # the first token stays for the names it carries
    rows = rows.filter(((i == 0) | (F.coalesce(inside, F.lit(False)) & ~comma)) & (table | end.isNotNull())).select(
        *keys, "name", "q", "i", "names", F.when(inside, own).otherwise("").alias("t"),
        F.when(i == F.col("start"), F.when(F.regexp_like(read, F.lit(_IS_NAME)), _bare(read)).otherwise("")).alias("source_table"))
    items = rows.groupBy(*keys, "name", "q").agg(_text().alias("item"), F.max("names").alias("names"), F.max("source_table").alias("source_table"))
    return items.select(*keys, "name", "q", "item", _bare(F.get(F.max("names").over(whole), F.col("q").cast("int"))).alias("target"),
                        F.max("source_table").over(whole).alias("source_table")).filter("item <> ''")


def harvest_ddl(files: DataFrame) -> Catalogs:
    """Scripts: table and base-view columns, views, and the positional mappings of INSERT … SELECT.

    A script is cut into statements and lists by quotes, parentheses and commas, and the words
    of their heads tell the statements apart. It is no grammar. Views of ``.vql`` files also map
    their source columns; a ``.vw`` file without a table or view is taken whole as a view named
    after the file.
    """
    vql = extension(F.col("path")) == ".vql"
    schema = F.when(vql, F.lit("denodo")).otherwise(F.lit(""))
    sources = _sources_of_parts(files)
    parts = _parts(sources)
    kind, d, q = F.col("kind"), F.col("item"), F.col("q")

    # columns of tables and of views come from one pass over the parts
    table = kind == "TABLE"
    shown = F.coalesce("target", F.regexp_extract(d, r'(\w+)[`"\]]?$', 1))
    cells = parts.filter(F.when(table, ~F.regexp_like(d, F.lit(_CONSTRAINT))).otherwise((kind == "VIEW") & (shown != "")))
    place = F.row_number().over(Window.partitionBy("path", "p", "kind").orderBy("q")) - 1
    unquoted = F.regexp_replace(d, r"""'[^']*+'|"[^"]*+"|`[^`]*+`""", "x")  # comments and defaults say nothing of the column
    own_name = _first(F.regexp_extract(d, r'^[`"\[]([^`"\]]++)', 1), F.regexp_extract(d, r'^(\w+)', 1))
    key = F.when(F.regexp_like(unquoted, F.lit(r"(?i)PRIMARY\s+KEY")), "PRIMARY KEY").when(
        F.regexp_like(unquoted, F.lit(r"(?i)REFERENCES\s")), "FOREIGN KEY").otherwise("")
    columns = _shape(cells, COLUMN_FIELDS, tool="script", source_file=F.col("path"), position=F.col("p"), table_name=F.col("name"), schema_name=schema,
                     role=F.when(table, "source").otherwise("view"), ordinal=F.when(table, place).otherwise(q),
                     column_name=F.when(table, own_name).otherwise(shown),
                     data_type=F.when(table, F.regexp_extract(d, r'^(?:[`"\[][^`"\]]++[`"\]]|\w++)\s+(' + _TYPE + ')', 1)).otherwise(""),
                     nullable=~table | ~F.regexp_like(unquoted, F.lit(r"(?i)NOT\s+NULL")),
                     key_type=F.when(table, key).otherwise(""), expression=F.when(table, "").otherwise(d))

    insert = kind == "INSERT"
    moved = parts.filter(F.when(insert, F.coalesce("target", F.lit("")) != "").otherwise((kind == "VIEW") & vql & (shown != "")))
    source = F.when(insert, _bare(d)).otherwise(_bare(F.substring_index(d, ".", -1)))
    mappings = _shape(moved, MAPPING_FIELDS, tool="script", source_file=F.col("path"), ordinal=F.when(insert, _place("p", "q")).otherwise(q),
                      source_table=F.col("source_table"), source_column=source, target_table=F.col("name"),
                      target_column=F.when(insert, F.col("target")).otherwise(shown), expression=F.when(insert, source).otherwise(d))
    views = _shape(sources.filter(kind == "VIEW"), VIEW_FIELDS, tool="script", source_file=F.col("path"), name=F.col("name"), schema_name=schema, sql=F.col("text"))
    return Catalogs(columns, mappings, _none(files.sparkSession, TRANSFORM_FIELDS), views)


def data_sources(files: DataFrame) -> DataFrame:
    """Names of the data sources scripts create."""
    return _heads(_statements(files)).filter("made = 'SOURCE'").select("path", F.col("name").alias("data_source"))


# --------------------------------------------------------------------- all together

def merge(parts: Sequence[Catalogs]) -> Catalogs:
    """One set of catalogs from several harvests, a table counting once per tool and file."""
    def union(name: str) -> DataFrame:
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [getattr(p, name) for p in parts])

    columns = union("columns").withColumn("__u", F.upper("table_name"))
    identity = ["tool", "source_file", "role", "__u", "ordinal"]
    return Catalogs(first_by(columns, identity, ["position"]).drop("__u"), union("mappings"), union("transforms"), union("views"))


def unify(columns: DataFrame) -> DataFrame:
    """Tables once per tool, whatever files they came from; the first file keeps its columns."""
    # one row per table and file is compared; the columns follow it through an equi join
    home = first_by(columns.select("tool", "role", "table_name", "source_file", "position").distinct(),
                    ["tool", "role", "table_name"], ["source_file", "position"])
    return columns.join(home, ["tool", "role", "table_name", "source_file", "position"], "left_semi")


def harvest(files: DataFrame) -> Catalogs:
    """Route files by extension and merge what each harvester finds; unknown extensions are read as scripts."""
    ext, text = extension(F.col("path")), F.col("content")
    is_mapping = text.contains("<POWERMART") | text.contains("<MAPPING")
    xml = files.filter(ext.isin(".xml", ".dsx"))
    return merge([
        harvest_jobs(xml.filter(~is_mapping)), harvest_mappings(xml.filter(is_mapping)),
        harvest_replication(files.filter(ext == ".atl")), harvest_ddl(files.filter(~ext.isin(".xml", ".dsx", ".atl"))),
    ])


def provenance(files: DataFrame, parsed_at: str) -> DataFrame:
    """Tool, file and time of every harvested file."""
    ext = extension(F.col("path"))
    tool = F.when(ext.isin(".xml", ".dsx"), F.when(F.col("content").contains("<POWERMART"), "mapping_export").otherwise("job_export")).when(
        ext == ".atl", "replication").otherwise("script")
    return files.select(tool.alias("tool"), F.col("path").alias("file"), F.lit(parsed_at).alias("parsed_at"))
