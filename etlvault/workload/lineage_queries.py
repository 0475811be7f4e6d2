"""Alignment, lineage and metadata scores over names and catalogs derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from etlvault.plans import lineage, scoring
from etlvault.workload import derived
from etlvault.workload.tables import table


def align_concepts(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select(F.col("c_name").alias("entity"))
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("sales_order_"), F.col("o_orderpriority"), F.lit("_"), F.col("o_orderkey").cast("string")))
    supplier = table(spark, sf_dir, "supplier").select("s_name")
    columns = derived.columns(spark, sf_dir).select(F.concat("table_name", F.lit("."), "column_name"))
    return lineage.align(customer.union(orders).union(supplier).union(columns), "entity")


def lineage_edges(spark, sf_dir):
    return lineage.edges(derived.mappings(spark, sf_dir)).distinct()


def lineage_table_edges(spark, sf_dir):
    return lineage.table_edges(derived.mappings(spark, sf_dir))


def lineage_nodes(spark, sf_dir):
    return lineage.nodes(derived.catalog(spark, sf_dir)).withColumn("columns", F.array_join("columns", ","))


def _metadata(spark, sf_dir):
    """Our catalogs, and a second harvest that missed large columns and returned lines and spells expressions its own way."""
    columns, maps = derived.columns(spark, sf_dir), derived.mappings(spark, sf_dir)
    views = table(spark, sf_dir, "part").select(F.concat(F.lit("V_"), "p_brand", F.lit("_"), F.col("p_size").cast("string")).alias("name"), "p_type")
    ours = scoring.Metadata(columns, maps, views)
    spelled = F.replace(F.lower("expression"), F.lit(", "), F.lit(",\n  "))
    theirs = scoring.Metadata(
        derived.columns(spark, sf_dir).filter(F.col("data_type") != "DECIMAL(18,2)"),
        maps.filter(~F.col("expression").startswith("UPPER")).withColumn("expression", F.when(F.col("ordinal") < 6, spelled).otherwise("LOWER(X)")),
        views.filter("p_type <> 'PROMO'").select(F.lower("name").alias("name")))
    return ours, theirs


def score_tables(spark, sf_dir):
    ours, theirs = _metadata(spark, sf_dir)
    return (scoring.set_score(ours.columns, theirs.columns, ["table_name"], "Table Coverage")
            .unionByName(scoring.set_score(ours.views, theirs.views, ["name"], "View Detection"))
            .unionByName(scoring.set_score(ours.mappings, theirs.mappings, ["source_table", "target_table"], "Lineage Depth")))


def score_columns(spark, sf_dir):
    ours, theirs = _metadata(spark, sf_dir)
    return scoring.column_scores(ours.columns, theirs.columns).withColumn("f1", F.round("f1", 3))


def score_mappings(spark, sf_dir):
    ours, theirs = _metadata(spark, sf_dir)
    return scoring.mapping_accuracy(ours.mappings, theirs.mappings)


def score_confidence(spark, sf_dir):
    return scoring.confidence(scoring.scores(*_metadata(spark, sf_dir)), "second harvest")


QUERIES = {
    "align_concepts": align_concepts, "lineage_edges": lineage_edges, "lineage_table_edges": lineage_table_edges,
    "lineage_nodes": lineage_nodes, "score_tables": score_tables, "score_columns": score_columns, "score_mappings": score_mappings,
    "score_confidence": score_confidence,
}


def _case(concepts, default, i) -> str:
    tests = " ".join(f"when contains(upper(entity), '{k}') then '{v[i]}'" for k, v in concepts.items())
    return f"case {tests} else '{default[i]}' end"


_META = f"""
{derived.CATALOG_SQL},
views as (select 'V_' || p_brand || '_' || p_size as name, p_type from part),
tcols as (select * from cat where data_type <> 'DECIMAL(18,2)'),
tmaps as (select * replace (case when ordinal < 6 then replace(lower(expression), ', ', ',' || chr(10) || '  ') else 'LOWER(X)' end as expression)
          from maps where not starts_with(expression, 'UPPER'))"""


def _set_sql(dimension: str, ours: str, theirs: str) -> str:
    return f"""
        select '{dimension}' as dimension, o as our_count, r as ref_count, m as matched, round(m / o, 3) as precision, round(m / r, 3) as recall,
               round(2 * (m / o) * (m / r) / (m / o + m / r), 3) as f1, round(m / (o + r - m), 3) as jaccard
        from (select (select count(*) from ({ours})) as o, (select count(*) from ({theirs})) as r,
                     (select count(*) from ({ours} intersect {theirs})) as m)"""


_SETS = " union all ".join([
    _set_sql("Table Coverage", "select distinct upper(table_name) from cat", "select distinct upper(table_name) from tcols"),
    _set_sql("View Detection", "select distinct upper(name) from views", "select distinct upper(name) from views where p_type <> 'PROMO'"),
    _set_sql("Lineage Depth", "select distinct source_table, target_table from maps", "select distinct source_table, target_table from tmaps")])
_COLS = """
    cs as (select t, count(distinct c) filter (where o = 1) as oc, count(distinct c) filter (where o = 0) as rc from (
             select table_name as t, column_name as c, 1 as o from cat union all select table_name, column_name, 0 from tcols) group by 1),
    cm as (select table_name as t, count(*) as m from (select distinct table_name, column_name from cat intersect select distinct table_name, column_name from tcols) group by 1),
    cf as (select cs.t, oc, rc, coalesce(m, 0) as m, case when coalesce(m, 0) = 0 then 0.0 else 2 * (m / oc) * (m / rc) / (m / oc + m / rc) end as f1
           from cs left join cm on cm.t = cs.t where oc > 0 and rc > 0)"""
_NORM = "max(regexp_replace(upper(case when expression = '' then 'DIRECT' else expression end), '\\s+', ' ', 'g'))"
_MAPS = f"""
    mo as (select upper(source_table) as a, upper(source_column) as b, upper(target_table) as c, upper(target_column) as d, {_NORM} as e from maps group by 1, 2, 3, 4),
    mr as (select upper(source_table) as a, upper(source_column) as b, upper(target_table) as c, upper(target_column) as d, {_NORM} as e from tmaps group by 1, 2, 3, 4),
    mm as (select count(*) as m, count(*) filter (where mo.e = mr.e or mo.e = 'DIRECT' or mr.e = 'DIRECT') as ok from mo join mr using (a, b, c, d)),
    ms as (select 'Mapping Accuracy' as dimension, o as our_count, r as ref_count, m as matched, round(m / o, 3) as precision, round(m / r, 3) as recall,
             round(2 * (m / o) * (m / r) / (m / o + m / r), 3) as f1, cast(round(ok * 100.0 / m, 1) as double) as expression_match_pct
           from mm, (select count(*) as o from mo), (select count(*) as r from mr))"""

ORACLE = {
    "align_concepts": f"""
        with {derived.CATALOG_SQL}, e as (
          select c_name as entity from customer union all select 'sales_order_' || o_orderpriority || '_' || o_orderkey from orders
          union all select s_name from supplier union all select table_name || '.' || column_name from cat)
        select entity, {_case(lineage.ONTOLOGY_CONCEPTS, lineage.NO_ONTOLOGY, 0)} as concept_class, {_case(lineage.ONTOLOGY_CONCEPTS, lineage.NO_ONTOLOGY, 1)} as concept_domain,
               {_case(lineage.ONTOLOGY_CONCEPTS, lineage.NO_ONTOLOGY, 2)} as concept_module, {_case(lineage.SERVICE_DOMAINS, lineage.NO_DOMAIN, 0)} as service_domain,
               {_case(lineage.SERVICE_DOMAINS, lineage.NO_DOMAIN, 1)} as business_area, {_case(lineage.SERVICE_DOMAINS, lineage.NO_DOMAIN, 2)} as service_version from e""",
    "lineage_edges": f"""with {derived.CATALOG_SQL} select distinct source_table as from_table, source_column as from_column, target_table as to_table,
        target_column as to_column, expression from maps""",
    "lineage_table_edges": f"""with {derived.CATALOG_SQL} select source_table as from_table, target_table as to_table, count(*) as column_edges from maps group by all""",
    "lineage_nodes": f"""with {derived.CATALOG_SQL}, n as (select table_name, column_name, min(schema_name) as s, min(ordinal) as o from cat group by all)
        select table_name as id, 'table' as type, min(s) as schema_name, string_agg(column_name, ',' order by o, column_name) as columns from n group by 1
        union all select 'TGT_S' || lpad(cast(s_suppkey as varchar), 9, '0'), 'table', 'DW', 'S_NAME' from supplier""",
    "score_tables": f"with {_META} {_SETS}",
    "score_columns": f"with {_META}, {_COLS} select t as table_name, oc as our_count, rc as ref_count, m as matched, round(f1, 3) as f1 from cf",
    "score_mappings": f"with {_META}, {_MAPS} select * from ms",
    "score_confidence": f"""with {_META}, {_COLS}, {_MAPS}, s as (
          select dimension, f1 from ({_SETS}) union all select 'Column Coverage', round(avg(f1), 3) from cf union all select dimension, f1 from ms)
        select 'second harvest' as tool, cast(round(sum(cast(f1 as decimal(12,8)) * case dimension when 'Mapping Accuracy' then 0.30 when 'Table Coverage' then 0.25
               when 'Column Coverage' then 0.25 else 0.10 end) * 100, 1) as double) as confidence from s""",
}
