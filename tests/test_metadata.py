"""Harvest, mapping, model, rules, alignment, lineage and scores on small artifacts."""

import pytest
from pyspark.sql import functions as F

from etlvault.plans import lineage, mapping, model, rules, scoring
from etlvault.sources import artifacts, history

JOB = """<?xml version="1.0"?><DSExport><Job Identifier="J1">
<Stage Identifier="SRC_CUSTOMER" StageType="SequentialFile"><Column Identifier="CUSTOMER_ID" SqlType="INTEGER" Nullable="N"/>
<Column Identifier="EMAIL" SqlType="VARCHAR(255)" Nullable="Y" Derivation="LOWER(EMAIL)"/></Stage>
<Stage Identifier="STEP" StageType="Transformer"><Clause Value="X = TRIM(Y)"/></Stage>
<Stage Identifier="OUT" StageType="SequentialFile"><Property name="TableName">TGT_CUSTOMER</Property><Column Identifier="CUSTOMER_HK" SqlType="VARCHAR(32)" Nullable="false"/></Stage>
<Link SourceStage="SRC_CUSTOMER" TargetStage="STEP"><Column Identifier="CUSTOMER_ID"/></Link>
<Link SourceStage="STEP" TargetStage="OUT"><Column Identifier="CUSTOMER_HK" Derivation="MD5(CUSTOMER_ID)"/></Link></Job></DSExport>"""
MART = """<?xml version="1.0"?><!DOCTYPE POWERMART SYSTEM "powrmart.dtd"><POWERMART><REPOSITORY NAME="R"><FOLDER NAME="F">
<SOURCE DBDNAME="OPS" NAME="SRC_PRODUCT"><SOURCEFIELD NAME="PRODUCT_ID" DATATYPE="number" NULLABLE="NOT NULL" KEYTYPE="PRIMARY KEY"/></SOURCE>
<TARGET DBDNAME="DW" NAME="TGT_FACT"><TARGETFIELD NAME="PRODUCT_HK" DATATYPE="varchar2" NULLABLE="NULL" KEYTYPE="FOREIGN KEY"/></TARGET>
<MAPPING NAME="M"><TRANSFORMATION NAME="E" TYPE="Expression"><TRANSFORMFIELD NAME="PRODUCT_ID" EXPRESSION="MD5(PRODUCT_ID)"/>
<TRANSFORMFIELD NAME="Q" DEFAULTVALUE="NVL(Q, 0)"/></TRANSFORMATION>
<CONNECTOR FROMINSTANCE="SRC_PRODUCT" FROMFIELD="PRODUCT_ID" TOINSTANCE="TGT_FACT" TOFIELD="PRODUCT_HK"/></MAPPING></FOLDER></REPOSITORY></POWERMART>"""
SQL = """-- CREATE TABLE hidden (a INT);
CREATE TABLE SRC_ORDER (
  ORDER_ID INTEGER NOT NULL PRIMARY KEY,
  CUSTOMER_ID INTEGER NOT NULL,
  ORDER_AMOUNT DECIMAL(18,2),
  CONSTRAINT c CHECK (ORDER_ID > 0)
);
CREATE OR REPLACE VIEW V_ACTIVE AS SELECT ORDER_ID FROM SRC_ORDER WHERE 1 = 1;
INSERT INTO TGT_FACT_ORDER (ORDER_HK, AMOUNT)
SELECT MD5(CAST(ORDER_ID AS VARCHAR)), NVL(ORDER_AMOUNT, 0)
FROM   SRC_ORDER
WHERE  1 = 1;"""
VQL = """CREATE OR REPLACE JDBC DATASOURCE ds_erp ENABLE;
CREATE OR REPLACE BASE VIEW bv_product ( PRODUCT_ID int, PRODUCT_NAME text );
CREATE OR REPLACE VIEW v_sum AS SELECT p.PRODUCT_ID, SUM(p.PRICE) AS TOTAL FROM bv_product p;"""
ATL = """{"task": {"name": "t", "tableRules": [{"tableName": "CUSTOMER", "schemaName": "SALES", "columns": [
 {"columnName": "CUST_ID", "dataType": "INT4", "isPrimaryKey": true, "nullable": false}, {"column_name": "EMAIL", "data_type": "STRING"}]}]}}"""
ATL_XML = """<Task><Table TableName="ACC" Schema="S"><Col ColumnName="ID" DataType="INT" Nullable="N" IsPK="Y"/><Col ColumnName="X"/></Table>
<Table TableName="B"><Col ColumnName="Y" DataType="DATE" Expression="TRIM(Y)"/></Table></Task>"""
VW = "SELECT c.ID, c.NAME AS FULL_NAME FROM CUSTOMER c"
FILES = {"job.dsx": JOB, "mart_informatica.xml": MART, "orders.sql": SQL, "products.vql": VQL, "task.atl": ATL, "task2.atl": ATL_XML,
         "customer.vw": VW, "bad.xml": "<<not xml>>", "empty.vw": "", "noise.md": "nothing here"}


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("artifacts")
    for name, text in FILES.items():
        (folder / name).write_text(text)
    return artifacts.read_files(spark, str(folder))


def of(files, *names):
    return files.filter(artifacts.file_name(F.col("path")).isin(*names))


def names(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_job_export(files):
    c = artifacts.harvest_jobs(of(files, "job.dsx", "bad.xml"))
    assert names(c.columns, "role", "table_name", "column_name", "nullable") == [
        ("source", "SRC_CUSTOMER", "CUSTOMER_ID", False), ("source", "SRC_CUSTOMER", "EMAIL", True), ("target", "TGT_CUSTOMER", "CUSTOMER_HK", False)]
    assert names(c.mappings, "source_table", "source_column", "target_table", "expression") == [
        ("SRC_CUSTOMER", "CUSTOMER_ID", "STEP", ""), ("STEP", "CUSTOMER_HK", "OUT", "MD5(CUSTOMER_ID)")]
    assert names(c.transforms, "name", "expression") == [("STEP", "X = TRIM(Y)")]
    # by type alone a file stage counts as a source on both ends
    by_type = artifacts.harvest_jobs(of(files, "job.dsx"), stage_type_only=True).columns
    assert {r.role for r in by_type.collect()} == {"source"}


def test_mapping_export(files):
    c = artifacts.harvest_mappings(of(files, "mart_informatica.xml"))
    assert names(c.columns, "role", "schema_name", "table_name", "column_name", "nullable", "key_type") == [
        ("source", "OPS", "SRC_PRODUCT", "PRODUCT_ID", False, "PRIMARY KEY"), ("target", "DW", "TGT_FACT", "PRODUCT_HK", True, "FOREIGN KEY")]
    assert names(c.transforms, "field", "expression", "type") == [("PRODUCT_ID", "MD5(PRODUCT_ID)", "expression"), ("Q", "NVL(Q, 0)", "expression")]
    assert names(c.mappings, "source_table", "source_column", "target_table", "target_column") == [("SRC_PRODUCT", "PRODUCT_ID", "TGT_FACT", "PRODUCT_HK")]


def test_scripts(files):
    c = artifacts.harvest_ddl(of(files, "orders.sql", "products.vql", "customer.vw", "empty.vw", "noise.md"))
    assert names(c.columns.filter("role = 'source'"), "table_name", "column_name", "data_type", "nullable", "key_type") == [
        ("SRC_ORDER", "CUSTOMER_ID", "INTEGER", False, ""), ("SRC_ORDER", "ORDER_AMOUNT", "DECIMAL(18,2)", True, ""),
        ("SRC_ORDER", "ORDER_ID", "INTEGER", False, "PRIMARY KEY"), ("bv_product", "PRODUCT_ID", "int", True, ""),
        ("bv_product", "PRODUCT_NAME", "text", True, "")]
    assert {r.schema_name for r in c.columns.filter("table_name = 'bv_product'").collect()} == {"denodo"}
    assert names(c.views, "name") == [("V_ACTIVE",), ("customer",), ("v_sum",)]
    assert names(c.mappings, "source_table", "source_column", "target_table", "target_column") == [
        ("SRC_ORDER", "MD5(CAST(ORDER_ID AS VARCHAR))", "TGT_FACT_ORDER", "ORDER_HK"), ("SRC_ORDER", "NVL(ORDER_AMOUNT, 0)", "TGT_FACT_ORDER", "AMOUNT"),
        ("bv_product", "PRICE) AS TOTAL", "v_sum", "TOTAL"), ("bv_product", "PRODUCT_ID", "v_sum", "PRODUCT_ID")]
    assert names(artifacts.data_sources(of(files, "products.vql")), "data_source") == [("ds_erp",)]


def test_replication(files):
    c = artifacts.harvest_replication(of(files, "task.atl", "task2.atl"))
    assert names(c.columns, "table_name", "schema_name", "column_name", "data_type", "nullable", "key_type") == [
        ("ACC", "S", "ID", "INT", False, "PRIMARY KEY"), ("ACC", "S", "X", "VARCHAR", True, ""), ("B", "", "Y", "DATE", True, ""),
        ("CUSTOMER", "SALES", "CUST_ID", "INT4", False, "PRIMARY KEY"), ("CUSTOMER", "SALES", "EMAIL", "STRING", True, "")]
    assert names(c.transforms, "expression") == [("TRIM(Y)",)]


def test_routing_and_merge(files):
    c = artifacts.harvest(files)
    assert {r.tool for r in c.columns.select("tool").distinct().collect()} == {"job_export", "mapping_export", "script", "replication"}
    twice = artifacts.merge([artifacts.harvest_ddl(of(files, "orders.sql"))] * 2)
    assert twice.columns.filter("role = 'source'").count() == 3
    moved = artifacts.harvest_ddl(of(files, "orders.sql")).columns.filter("role = 'source'")
    both = moved.unionByName(moved.withColumn("source_file", F.lit("zzz")))
    assert artifacts.unify(both).count() == 3
    routes = {r.path.rsplit("/", 1)[1]: r.tool for r in artifacts.route(files).collect()}
    assert routes["job.dsx"] == "job_export" and routes["mart_informatica.xml"] == "mapping_export" and routes["orders.sql"] is None
    assert artifacts.provenance(files, "now").count() == len(FILES) - 1  # an empty file gives no row


def test_corpus_reads_by_extension(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.SQL").write_text("select 1")
    (tmp_path / "sub" / "b.jcl").write_text("//A JOB x")
    (tmp_path / "c.bin").write_text("x")
    assert artifacts.corpus(spark, str(tmp_path)).count() == 2


CATALOG = [("SRC_CUSTOMER", [("CUSTOMER_ID", "INTEGER", False, "PRIMARY KEY"), ("FIRST_NAME", "VARCHAR(100)", True, ""), ("EMAIL", "VARCHAR(255)", True, ""),
                             ("CREATED_DATE", "DATE", False, "")]),
           ("SRC_ORDER", [("ORDER_ID", "INTEGER", False, "PRIMARY KEY"), ("CUSTOMER_ID", "INTEGER", False, "FOREIGN KEY"),
                          ("PRODUCT_ID", "INTEGER", False, "FOREIGN KEY"), ("ORDER_AMOUNT", "DECIMAL(18,2)", True, ""), ("STATUS", "VARCHAR(50)", True, "")]),
           ("SRC_PRODUCT", [("PRODUCT_ID", "INTEGER", False, "PRIMARY KEY"), ("UNIT_PRICE", "DECIMAL(18,2)", False, "")]),
           ("SRC_NOTE", [("BODY", "TEXT", True, "")])]


@pytest.fixture(scope="module")
def catalog(spark):
    data = [("job_export", "f", "", p, t, "OPS", "source", o, c, d, "", n, k, "") for p, (t, cs) in enumerate(CATALOG) for o, (c, d, n, k) in enumerate(cs)]
    data.append(("job_export", "f", "", 9, "TGT_DIM_CUSTOMER", "DW", "target", 0, "FULL_NAME", "VARCHAR(200)", "", True, "", ""))
    return spark.createDataFrame(data, ", ".join(f"{k} {v}" for k, v in artifacts.COLUMN_FIELDS.items()))


@pytest.fixture(scope="module")
def sttm(spark, catalog):
    maps = [("SRC_CUSTOMER", "CUSTOMER_ID", "TGT_DIM_CUSTOMER", "CUSTOMER_HK", "MD5(CUSTOMER_ID)"), ("SRC_CUSTOMER", "FIRST_NAME", "TGT_DIM_CUSTOMER", "FULL_NAME", ""),
            ("SRC_CUSTOMER", "FIRST_NAME", "TGT_DIM_CUSTOMER", "FULL_NAME", "LATER"), ("SRC_CUSTOMER", "EMAIL", "TGT_DIM_CUSTOMER", "EMAIL", "")]
    m = spark.createDataFrame([("job_export", "f", "", i, *x) for i, x in enumerate(maps)], ", ".join(f"{k} {v}" for k, v in artifacts.MAPPING_FIELDS.items()))
    t = spark.createDataFrame([("job_export", "f", "", 0, "E", "expression", "first_name", "TRIM(FIRST_NAME)", "")],
                              ", ".join(f"{k} {v}" for k, v in artifacts.TRANSFORM_FIELDS.items()))
    return lambda **o: mapping.build_sttm(catalog, m, t, "DB", "DW", **o)


def test_sttm(sttm):
    built = {(r.source_column, r.target_column): r for r in mapping.mapped(sttm()).collect()}
    assert len(built) == 3
    name = built[("FIRST_NAME", "FULL_NAME")]
    assert (name.expression, name.transformation_type, name.target_data_type, name.source_schema, name.pii_flag) == (
        "TRIM(FIRST_NAME)", "STRING_TRANSFORM", "VARCHAR(200)", "OPS", "Y")
    key = built[("CUSTOMER_ID", "CUSTOMER_HK")]
    assert (key.mapping_id, key.transformation_type, key.is_pk, key.nullable) == ("MAP_0001", "HASH", "Y", "N")
    assert built[("EMAIL", "EMAIL")].transformation_type == "DIRECT"
    s = mapping.summarise(sttm()).collect()[0]
    assert (s.total_mappings, s.mapped, s.unmapped, s.target_tables) == (12, 3, 9, 1)
    everything = mapping.summarise(sttm(list_all_sources=True)).collect()[0]
    assert (everything.mapped, everything.unmapped) == (3, 12)
    assert mapping.unmapped(sttm()).filter("source_column = 'EMAIL'").count() == 0
    assert mapping.personal(sttm()).count() == 2
    by_strategy = mapping.summarise_by(mapping.mapped(sttm()).withColumn("load_strategy", F.lit("FULL")), ["tool", "load_strategy"]).collect()
    assert [(r.tool, r.load_strategy, r.mappings, r.pk_columns, r.direct, r.transformed) for r in by_strategy] == [("job_export", "FULL", 3, 1, 1, 2)]


@pytest.mark.parametrize("expression,want,short", [
    ("", "DIRECT", "DIRECT"), ("MD5(a)", "HASH", "HASH"), ("ACCOUNT", "AGGREGATE", "EXPRESSION"), ("CASE WHEN a THEN b END", "CONDITIONAL", "EXPRESSION"),
    ("a || b", "STRING_TRANSFORM", "EXPRESSION"), ("TO_DATE(a)", "TYPE_CAST", "EXPRESSION"), ("LOOKUP(a)", "LOOKUP", "EXPRESSION"), ("a + 1", "EXPRESSION", "EXPRESSION"),
    ("SRC", "EXPRESSION", "DIRECT"), ("HASHED", "HASH", "EXPRESSION")])
def test_expression_classes(spark, expression, want, short):
    e = F.lit(expression)
    r = spark.range(1).select(mapping.expression_class(e).alias("a"), mapping.short_expression_class(e, F.lit("SRC")).alias("b")).collect()[0]
    assert (r.a, r.b) == (want, short)


def test_nested_mappings_explode(spark):
    df = spark.createDataFrame([("m", "FULL", [("A", "A_ID", True), ("B", "B", False)])], "mapping_name string, load_strategy string, columns array<struct<src:string,tgt:string,pk:boolean>>")
    assert names(mapping.explode_mappings(df), "ordinal", "src", "pk") == [(0, "A", True), (1, "B", False)]


def test_model(catalog):
    keys = model.business_keys(catalog)
    assert {r.table_name: r.business_keys for r in keys.collect()} == {
        "SRC_CUSTOMER": ["CUSTOMER_ID"], "SRC_ORDER": ["ORDER_ID", "CUSTOMER_ID", "PRODUCT_ID"], "SRC_PRODUCT": ["PRODUCT_ID"], "SRC_NOTE": ["BODY"]}
    primary = {r.table_name: r.business_keys for r in model.business_keys(catalog, prefer_primary=True).collect()}
    assert primary["SRC_ORDER"] == ["ORDER_ID"]
    assert names(model.build_hubs(keys), "hub_name", "hash_key", "source_table") == [
        ("HUB_CUSTOMER", "CUSTOMER_HK", "SRC_CUSTOMER"), ("HUB_NOTE", "NOTE_HK", "SRC_NOTE"), ("HUB_ORDER", "ORDER_HK", "SRC_ORDER"),
        ("HUB_PRODUCT", "PRODUCT_HK", "SRC_PRODUCT")]
    assert names(model.build_links(catalog), "link_name", "hub_a_hk", "hub_b_hk") == [
        ("LNK_CUSTOMER_ORDER", "CUSTOMER_HK", "ORDER_HK"), ("LNK_ORDER_PRODUCT", "ORDER_HK", "PRODUCT_HK")]
    sats = {r.sat_name: r for r in model.build_satellites(catalog, keys).collect()}
    assert set(sats) == {"SAT_CUSTOMER_CUSTOMER", "SAT_ORDER_ORDER", "SAT_PRODUCT_PRODUCT"}
    assert [(a.name, a.pii) for a in sats["SAT_CUSTOMER_CUSTOMER"].attributes] == [("FIRST_NAME", True), ("EMAIL", True), ("CREATED_DATE", False)]
    assert sats["SAT_ORDER_ORDER"].hashdiff == "ORDER_ORDER_HASHDIFF"
    assert names(model.relationships(catalog), "parent", "child") == [("SRC_CUSTOMER", "SRC_ORDER"), ("SRC_PRODUCT", "SRC_ORDER")]
    assert names(model.relationship_ends(catalog), "stem", "role", "table_name", "n_linked") == [
        ("CUSTOMER", "child", "SRC_ORDER", 1), ("CUSTOMER", "parent", "SRC_CUSTOMER", 1),
        ("PRODUCT", "child", "SRC_ORDER", 1), ("PRODUCT", "parent", "SRC_PRODUCT", 1)]


def test_names_and_types(spark):
    df = spark.createDataFrame([("src_dim_customer", "a-b c_", "DATETIME"), ("DIM_X", "__q", "number(18,2)")], "t string, n string, d string")
    assert names(df.select(model.entity_name(F.col("t")).alias("e"), model.sanitise(F.col("n")).alias("s"), model.type_label(F.col("d")).alias("d")), "e", "s", "d") == [
        ("DIM_CUSTOMER", "a_b_c", "date"), ("X", "q", "float")]
    assert spark.range(1).select(model.key_marker(F.lit("A_ID"), F.lit("")).alias("m")).collect()[0].m == "FK"


def test_generated_rules(catalog, sttm):
    keys = model.business_keys(catalog)
    made = rules.generate_rules(catalog, model.build_hubs(keys), model.build_links(catalog), sttm())
    kinds = {}
    for r in made.collect():
        kinds[r.check_type] = kinds.get(r.check_type, 0) + 1
    # not null: 7 columns and 2 PII mappings; unique: 6 business keys and 4 hub keys
    assert kinds == {"NOT_NULL": 9, "UNIQUE": 10, "REGEX": 1, "DATE_RANGE": 1, "RANGE": 2, "REFERENTIAL_INTEGRITY": 2}
    assert made.select("rule_id").distinct().count() == 25


def test_column_rules(spark):
    df = spark.createDataFrame([("CUSTOMER_ID", "INT", True, False), ("EMAIL", "VARCHAR", False, True), ("LOAD_DATE", "TIMESTAMP", False, True),
                                ("ORDER_ID", "INT", False, True), ("PRICE_CODE", "INT", False, True)], "target_column string, data_type string, is_pk boolean, nullable boolean")
    made = rules.infer_column_rules(df)
    assert {r.target_column: r.dq_rules for r in made.collect()} == {
        "CUSTOMER_ID": ["not_null", "unique"], "EMAIL": ["pattern_match"], "LOAD_DATE": ["date_format", "load_date_current", "no_future_dates"],
        "ORDER_ID": ["referential_int"], "PRICE_CODE": ["accepted_values", "positive_values"]}
    assert rules.critical(made).count() == 1 and rules.rule_totals(made).collect()[0].total_rules == 9


def test_alignment(spark):
    df = spark.createDataFrame([("CUSTOMER",), ("order_account",), ("WIDGET",), ("EMPLOYEE",)], "e string")
    got = {r.e: (r.concept_class, r.service_domain) for r in lineage.align(df, "e").collect()}
    assert got == {"CUSTOMER": ("fibo-be-le-lp:LegalPerson", "Customer Relationship Management"), "order_account": ("fibo-fbc-pas-caa:Account", "Current Account"),
                   "WIDGET": ("No FIBO match", "No BIAN match"), "EMPLOYEE": ("No FIBO match", "Human Resources")}


def test_scores(spark):
    def meta(columns, maps, views):
        return scoring.Metadata(spark.createDataFrame(columns, "table_name string, column_name string"),
                                spark.createDataFrame(maps, "source_table string, source_column string, target_table string, target_column string, expression string"),
                                spark.createDataFrame(views, "name string"))
    ours = meta([("A", "x"), ("A", "y"), ("B", "z")], [("A", "x", "T", "x", "trim( x )"), ("A", "y", "T", "y", "")], [("V",)])
    same = scoring.confidence(scoring.scores(ours, ours), "t").collect()[0]
    assert same.confidence == 100.0
    theirs = meta([("a", "X"), ("C", "q")], [("a", "x", "t", "x", "TRIM( X )"), ("A", "y", "T", "y", "UPPER(Y)")], [])
    got = {r.dimension: r.f1 for r in scoring.scores(ours, theirs).collect()}
    # no reference views at all counts as full agreement
    assert got == {"Table Coverage": 0.5, "Column Coverage": 0.667, "Mapping Accuracy": 1.0, "View Detection": 1.0, "Lineage Depth": 1.0}
    acc = scoring.mapping_accuracy(ours.mappings, theirs.mappings).collect()[0]
    assert (acc.matched, acc.expression_match_pct) == (2, 100.0)
    none = scoring.set_score(theirs.views, ours.views, ["name"], "d").collect()[0]
    assert (none.precision, none.recall, none.f1, none.jaccard) == (0.0, 0.0, 0.0, 0.0)
    assert scoring.set_score(theirs.views, theirs.views, ["name"], "d").collect()[0].jaccard == 1.0


def test_dimensions_of_shared_aggregates(spark):
    def side(columns, maps, views):
        return scoring.Metadata(
            spark.createDataFrame(columns, "table_name string, column_name string"),
            spark.createDataFrame(maps, "source_table string, source_column string, target_table string, target_column string, expression string"),
            spark.createDataFrame(views, "name string"))

    full = side([("a", "x"), ("a ", "y"), ("b", "z"), ("", "n"), (None, None)],
                [("a", "x", "t", "k", ""), (" A", "y", "t", "l", "f(y)"), ("", "q", "t", "m", None), ("b", "z", "u", "k", "z"), (None, "w", "u", "k", "")], [("v",), ("w",)])
    part = side([("A", "X"), ("c", "z")], [("A", "X", "T", "K", "x"), ("a", "x", "u", "k", "")], [("V",)])
    none = side([], [], [])
    hops = ["source_table", "target_table"]
    for ours, theirs in ((full, part), (part, full), (full, none), (none, full), (none, none)):
        apart = [scoring.set_score(ours.columns.select("table_name"), theirs.columns.select("table_name"), ["table_name"], "Table Coverage"),
                 scoring.column_coverage(ours.columns, theirs.columns), scoring.mapping_accuracy(ours.mappings, theirs.mappings),
                 scoring.set_score(ours.views, theirs.views, ["name"], "View Detection"),
                 scoring.set_score(ours.mappings.select(hops), theirs.mappings.select(hops), hops, "Lineage Depth")]
        want = {r.dimension: r.f1 for df in apart for r in df.select("dimension", "f1").collect()}
        assert {r.dimension: r.f1 for r in scoring.scores(ours, theirs).collect()} == want


def test_metadata_round_trip(spark, catalog, tmp_path):
    history.write_metadata({"columns": catalog}, str(tmp_path))
    schema = ", ".join(f"{k} {v}" for k, v in artifacts.COLUMN_FIELDS.items())
    assert names(history.read_metadata(spark, str(tmp_path), {"columns": schema})["columns"], "table_name", "column_name") == names(catalog, "table_name", "column_name")
    other = spark.createDataFrame([("a", "b", None, "d"), ("q", "r", "s", "t")], "src_table string, src_col string, target_table string, tgt_table string")
    assert names(history.to_common(other, "mapping"), "source_table", "source_column", "target_table") == [("a", "b", "d"), ("q", "r", "s")]


def scripts(spark, **files):
    return artifacts.harvest_ddl(spark.createDataFrame([(k.replace("_", "."), v) for k, v in files.items()], "path string, content string"))


def test_view_text_ends_with_its_statement(spark):
    got = scripts(spark, a_sql="""CREATE VIEW v AS SELECT id, created_at, amount AS total FROM orders WHERE create_date > 1;
        INSERT INTO t (x, y) SELECT f(a, b), 'p;q,(' FROM src WHERE z; CREATE OR REPLACE VIEW w AS WITH q AS (SELECT 1) SELECT k FROM q""")
    assert names(got.views, "name", "sql") == [
        ("v", "SELECT id, created_at, amount AS total FROM orders WHERE create_date > 1;"), ("w", "WITH q AS (SELECT 1) SELECT k FROM q")]
    assert names(got.columns.filter("role = 'view' AND table_name = 'v'"), "ordinal", "column_name") == [(0, "id"), (1, "created_at"), (2, "total")]
    assert names(got.mappings, "target_table", "target_column", "source_table", "expression") == [("t", "x", "src", "f(a, b)"), ("t", "y", "src", "'p;q,('")]


def test_table_bodies_nest_and_quote(spark):
    got = scripts(spark, a_sql="""CREATE TABLE q (a INT DEFAULT (coalesce((1),(2))), b VARCHAR(10) DEFAULT '; -- )', "c d" INT /* , z INT */, PRIMARY KEY (a))
        CREATE TABLE r (x DECIMAL(18, 2) NOT NULL)""", b_sql="CREATE TABLE open (u INT, v INT", c_vw="SELECT 1 FROM d", d_sql="")
    assert names(got.columns.filter("role = 'source'"), "table_name", "ordinal", "column_name", "data_type") == [
        ("open", 0, "u", "INT"), ("open", 1, "v", "INT"), ("q", 0, "a", "INT"), ("q", 1, "b", "VARCHAR(10)"), ("q", 2, "c d", "INT"), ("r", 0, "x", "DECIMAL(18, 2)")]
    assert names(got.views, "name", "sql") == [("c", "SELECT 1 FROM d")]


def test_wide_table(spark):
    body = ", ".join(f"c{i} DECIMAL(18,2) DEFAULT 'x'" for i in range(20_000))
    got = scripts(spark, a_sql=f"CREATE TABLE wide ({body});")
    r = got.columns.agg(F.count("*"), F.max("ordinal"), F.countDistinct("column_name"), F.min("data_type")).collect()[0]
    assert tuple(r) == (20_000, 19_999, 20_000, "DECIMAL(18,2)")


def test_wide_insert_and_view(spark):
    n = 5_000
    left, right = ", ".join(f"t{i}" for i in range(n)), ", ".join(f"f(s{i}, 'x,')" for i in range(n))
    got = scripts(spark, a_sql=f"INSERT INTO t ({left}) SELECT {right} FROM src; CREATE VIEW v ({left}) AS SELECT {right} FROM src")
    pairs = got.mappings.select("target_column", "expression", "source_table").unionByName(got.columns.select(F.col("column_name").alias("target_column"), "expression", F.lit("src").alias("source_table")))
    right_place = F.concat(F.lit("f("), F.replace("target_column", F.lit("t"), F.lit("s")), F.lit(", 'x,' )"))  # a space follows quoted text
    r = pairs.agg(F.count("*"), F.count_if((F.col("expression") == right_place) & (F.col("source_table") == "src"))).collect()[0]
    assert tuple(r) == (2 * n, 2 * n)


def test_view_files(spark):
    got = scripts(spark, a_vw="INSERT INTO t (x) SELECT a FROM b", b_vw="-- c\nSELECT k FROM \"m n\"", c_vw="CREATE TABLE u (z INT); SELECT 1 FROM d", d_vw=None, e_vw=";;")
    assert names(got.views.filter("name IN ('a', 'b', 'c')"), "name", "sql") == [("a", "INSERT INTO t (x) SELECT a FROM b"), ("b", "-- c\nSELECT k FROM \"m n\"")]
    assert names(got.mappings, "target_table", "target_column", "source_table") == [("t", "x", "b")]
    assert names(got.columns.filter("role = 'source'"), "table_name", "column_name") == [("u", "z")]


def test_replication_text_that_is_no_document(spark):
    text = 'rule log\n<Rule TableName="T" Schema="S"> & <Col ColumnName="A" DataType="INT" IsPK="Y">\n<Step TargetColumn="A" Expression="TRIM(A)"> end'
    got = artifacts.harvest_replication(spark.createDataFrame([("a.atl", text), ("b.atl", "no rules here"), ("c.atl", None)], "path string, content string"))
    assert names(got.columns, "table_name", "schema_name", "column_name", "key_type") == [("T", "S", "A", "PRIMARY KEY")]
    assert names(got.transforms, "name", "expression") == [("A", "TRIM(A)")]
    cut = '{"x": [{"expression": "UPPER(B)", "note": 1, "target_column": "B"}, {"expression": "lost"}, {"expression" : "c + 1", "target_column":"C"}'
    got = artifacts.harvest_replication(spark.createDataFrame([("a.atl", cut), ("b.atl", cut + "]}")], "path string, content string")).transforms
    assert names(got, "source_file", "name", "expression") == [("a.atl", "B", "UPPER(B)"), ("a.atl", "C", "c + 1")]


def test_listing_and_loads(spark):
    rows = [("f", "s", "a", "t", "CUSTOMER_EMAIL", ""), ("f", "s", "a", "t", "K", "a"), ("f", "s", "a", "t", "H", "md5(a)"), ("f", "s", "a", "t", None, None)]
    maps = spark.createDataFrame(rows, "source_file string, source_table string, source_column string, target_table string, target_column string, expression string")
    assert sorted((r.expression, r.transformation_type, r.pii_flag) for r in mapping.sheet(maps).collect()) == [
        ("DIRECT", "DIRECT", ""), ("DIRECT", "DIRECT", "PII"), ("a", "DIRECT", ""), ("md5(a)", "HASH", "")]
    cells = [("m", "A", "FULL", "Y", "DIRECT"), ("m", "A", "FULL", "N", "HASH"), ("n", "B", "FULL", "N", "DIRECT"), ("o", "B", None, None, None)]
    got = mapping.summarise_loads(spark.createDataFrame(cells, "mapping_name string, tool string, load_strategy string, is_pk string, transformation_type string"))
    found = {(r.tool, r.load_strategy): tuple(r)[2:] for r in got.collect()}
    assert found[(None, None)] == (3, 4, 1, 2, 2) and found[("A", None)] == (1, 2, 1, 1, 1) and found[(None, "FULL")] == (2, 3, 1, 2, 1)
    assert found[("B", "")] == (1, 1, 0, 0, 1) and len(found) == 8


def test_loads_are_dealt_into_parts_of_bounded_rows(spark):
    """The rows are grouped once they are dealt by mapping, and parts grow with the rows."""
    from etlvault.session import task_parts
    rows = spark.range(4000).selectExpr("concat('m', id % 900) AS mapping_name", "if(id % 900 < 300, 'A', NULL) AS tool", "'FULL' AS load_strategy",
                                        "if(id % 3 = 0, 'Y', 'N') AS is_pk", "if(id % 2 = 0, 'DIRECT', 'HASH') AS transformation_type")
    dealt, plain = mapping.summarise_loads(rows, 13), mapping.summarise_loads(rows)
    assert sorted(map(str, dealt.collect())) == sorted(map(str, plain.collect())) and not dealt.isEmpty()
    plan = dealt._jdf.queryExecution().sparkPlan().toString()
    assert "Expand" in plan and "RepartitionByExpression" in dealt._jdf.queryExecution().optimizedPlan().toString()
    assert task_parts(rows, 100) == 40 and task_parts(rows, 4000) == spark.sparkContext.defaultParallelism


def test_rules_at_any_level(spark):
    rules = '[{"tableName": "t", "columns": [{"columnName": "a"}, {"columnName": "b"}]}, {"tableName": "u", "columns": [{"columnName": "c"}]}]'
    deep = '{"k": ' * 12 + '{"note": "x \\"tables\\": [", "tableRules": ' + rules + ', "z": [1]}' + "}" * 12
    files = spark.createDataFrame([("a.atl", deep), ("b.atl", '[{"tables": ' + rules + '}, {"table_rules": ' + rules + "}]"), ("c.atl", "{broken"), ("d.atl", "")], "path string, content string")
    got = artifacts.harvest_replication(files).columns.groupBy("source_file").agg(F.count("*").alias("n"), F.countDistinct("position").alias("k"))
    assert names(got, "source_file", "n", "k") == [("a.atl", 3, 2), ("b.atl", 6, 4)]


def test_mapping_exports_are_parsed_once_for_sources_and_targets(spark):
    field = '<{0}FIELD NAME="{1}" DATATYPE="int" NULLABLE="NOT NULL" KEYTYPE="PRIMARY KEY"/>'
    text = ('<POWERMART><SOURCE NAME="A" DBDNAME="D">' + field.format("SOURCE", "x") + field.format("SOURCE", "y") + '</SOURCE><TARGET NAME="T">' + field.format("TARGET", "z")
            + '</TARGET><MAPPING NAME="M"><SOURCE>' + field.format("SOURCE", "w") + "</SOURCE></MAPPING></POWERMART>")
    found = artifacts.harvest_mappings(spark.createDataFrame([("m.xml", text), ("n.xml", "<POWERMART/>"), ("o.xml", "<broken")], "path string, content string")).columns
    assert names(found, "role", "table_name", "position", "ordinal", "column_name") == [
        ("source", "A", 0, 0, "x"), ("source", "A", 0, 1, "y"), ("source", "UNKNOWN_SOURCE", 1, 0, "w"), ("target", "T", 0, 0, "z")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("from_xml") + found._jdf.queryExecution().optimizedPlan().toString().count("xmltostructs") <= 2


def test_files_of_all_kinds_are_mixed_in_each_part(spark, monkeypatch):
    from etlvault.workload import catalog_queries
    sizes = []
    monkeypatch.setattr(catalog_queries, "cut_lineage", lambda df: sizes.append(df) or df)
    catalog_queries.harvest_all(spark, "/root/testdata/sf0.01")
    kinds = sizes[0].groupBy(F.spark_partition_id().alias("part")).agg(F.count_distinct(artifacts.extension(F.col("path"))).alias("n")).collect()
    assert len(kinds) == spark.sparkContext.defaultParallelism and {r.n for r in kinds} == {4}


def test_jobs_and_columns_at_any_level(spark):
    text = ('<?xml version="1.0"?><DSExport><Project><Job Identifier="J1"><Stage Identifier="S" StageType="OracleSource"><Record><Column Identifier="A" SqlType="INT"/>'
            '<Group><Column Name="B &gt; 1"></Column></Group></Record></Stage><Link SourceStage="S" TargetStage="T"><Columns><Column Identifier="A"/></Columns></Link></Job>'
            '<Job Identifier="J2"><Stages><DSStage Name="X" Type="odbc sink"/></Stages></Job></Project></DSExport>')
    got = artifacts.harvest_jobs(spark.createDataFrame([("a.dsx", text), ("b.dsx", "<broken")], "path string, content string"))
    assert names(got.columns, "job", "table_name", "ordinal", "column_name") == [("J1", "S", 0, "A"), ("J1", "S", 1, "B > 1")]
    assert names(got.mappings, "job", "source_table", "target_table", "source_column") == [("J1", "S", "T", "A")]


def test_many_folders(spark):
    folder = '<FOLDER NAME="F"><MAPPING NAME="M"><TRANSFORMATION NAME="E" TYPE="x">' + "".join(f'<TRANSFORMFIELD NAME="P{i}" EXPRESSION="{i}"/>' for i in range(1200)) + "</TRANSFORMATION></MAPPING></FOLDER>"
    got = artifacts.harvest_mappings(spark.createDataFrame([("a.xml", "<POWERMART>" + folder * 50 + "</POWERMART>")], "path string, content string")).transforms
    assert tuple(got.agg(F.count("*"), F.countDistinct("ordinal")).collect()[0]) == (60_000, 60_000)


def test_statement_heads_of_all_kinds(spark):
    c = scripts(spark, a_sql="""
        CREATE EXTERNAL TABLE IF NOT EXISTS ext_t (a INT, note VARCHAR(10) COMMENT 'is NOT NULL and PRIMARY KEY', d DOUBLE PRECISION NOT NULL,
          ts TIMESTAMP WITH TIME ZONE, n NUMERIC(10, 2) PRIMARY KEY);
        CREATE GLOBAL TEMPORARY TABLE tmp_t (k INT);
        CREATE OR REPLACE MATERIALIZED VIEW mv AS SELECT x, y + 1 AS z FROM ext_t;
        CREATE VIEW renamed (p, r) AS SELECT a, b FROM tmp_t;
        CREATE VIEW deep AS WITH q AS (SELECT k FROM tmp_t) SELECT k, 2 AS two FROM q;
        INSERT INTO tgt (u, v) WITH w AS (SELECT a, d FROM ext_t) SELECT a, d FROM w;
        INSERT OVERWRITE TABLE "s"."over" (m) SELECT a FROM (SELECT a FROM ext_t) s;
        CREATE TABLE copied AS SELECT a FROM ext_t;
        CREATE INDEX ix ON ext_t (a); CREATE FUNCTION f (x INT) RETURNS TABLE (y INT);
        UPDATE ext_t SET a = 1;""")
    got = [(r.table_name, r.column_name, r.data_type, r.nullable, r.key_type) for r in c.columns.filter("role = 'source'").orderBy("position", "ordinal").collect()]
    assert got == [("ext_t", "a", "INT", True, ""), ("ext_t", "note", "VARCHAR(10)", True, ""), ("ext_t", "d", "DOUBLE PRECISION", False, ""),
                   ("ext_t", "ts", "TIMESTAMP WITH TIME ZONE", True, ""), ("ext_t", "n", "NUMERIC(10, 2)", True, "PRIMARY KEY"), ("tmp_t", "k", "INT", True, "")]
    shown = sorted((r.table_name, r.ordinal, r.column_name, r.expression) for r in c.columns.filter("role = 'view'").collect())
    assert shown == [("deep", 0, "k", "k"), ("deep", 1, "two", "2 AS two"), ("mv", 0, "x", "x"), ("mv", 1, "z", "y + 1 AS z"), ("renamed", 0, "p", "a"), ("renamed", 1, "r", "b")]
    moved = sorted((r.source_table, r.source_column, r.target_table, r.target_column) for r in c.mappings.collect())
    assert moved == [("", "a", "s.over", "m"), ("w", "a", "tgt", "u"), ("w", "d", "tgt", "v")]
    assert sorted(r.name for r in c.views.collect()) == ["deep", "mv", "renamed"]


def test_data_sources_by_words(spark):
    files = spark.createDataFrame([("a.vql", "CREATE OR REPLACE JDBC DATASOURCE one x;CREATE DATA SOURCE two y; CREATE WRAPPER JDBC w DATASOURCENAME=one; CREATE SOURCE three;")],
                                  "path string, content string")
    assert sorted(r.data_source for r in artifacts.data_sources(files).collect()) == ["one", "two"]


def test_relationships_of_shared_stems_are_not_shuffled(spark, rows, monkeypatch):
    monkeypatch.setattr(model, "SHARE", 3, raising=False)  # several groups per stem
    tables = [f"SRC_RING_T{i:03d}" for i in range(10)]
    entries = [("x", "f", "", 0, t, "s", "source", j, c, "INTEGER", "", True, "NOT A KEY", "")
               for t in tables for j, c in enumerate(["RING_ID", "SRC_RING_ID", "T003_ID"])]
    catalog = spark.createDataFrame(entries, "tool string, source_file string, job string, position int, table_name string, schema_name string, "
                                             "role string, ordinal int, column_name string, data_type string, length string, nullable boolean, "
                                             "key_type string, expression string")
    pairs = model.relationships(catalog)
    assert rows(pairs, "parent", "child") == sorted(((p, c) for p in tables for c in tables), key=str)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")  # pairs leave the join as they are


def test_mapping_rows_are_joined_once_per_side(spark):
    kinds = ", ".join(f"{k} {v}" for k, v in artifacts.COLUMN_FIELDS.items())
    catalog = spark.createDataFrame([], kinds)
    m = spark.createDataFrame([("job_export", "f", "", 1, None, "first_name", "T", "A", "")], ", ".join(f"{k} {v}" for k, v in artifacts.MAPPING_FIELDS.items()))
    t = spark.createDataFrame([("job_export", "f", "", 0, "E", "expression", "first_name", "TRIM(FIRST_NAME)", "")],
                              ", ".join(f"{k} {v}" for k, v in artifacts.TRANSFORM_FIELDS.items()))
    built = mapping.build_sttm(catalog, m, t, "DB", "S", numbered=False)
    assert [(r["source_table"], r["source_column"], r["expression"]) for r in built.collect()] == [(None, "first_name", "TRIM(FIRST_NAME)")]
    node, joins = built._jdf.queryExecution().analyzed(), 0
    while node.nodeName() != "Aggregate":  # down the side of the mapping rows
        joins += node.nodeName() == "Join"
        node = node.children().apply(0)
    assert joins == 2
