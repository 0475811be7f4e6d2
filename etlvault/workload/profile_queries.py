"""Profiles of customer, lineitem and part."""

from __future__ import annotations

from pyspark.sql import functions as F

from etlvault.operators import pii, profile
from etlvault.workload.tables import table, wide

RUN_TS = "2024-01-02 00:00:00"
LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CUSTOMER_KINDS = {"c_custkey": "Numeric", "c_name": "Categorical", "c_nationkey": "Numeric", "c_acctbal": "Numeric",
                  "c_mktsegment": "Categorical"}
LINE_KINDS = {"l_orderkey": "Numeric", "l_partkey": "Numeric", "l_suppkey": "Numeric", "l_linenumber": "Numeric",
              "l_quantity": "Numeric", "l_extendedprice": "Numeric", "l_discount": "Numeric", "l_tax": "Numeric",
              "l_returnflag": "Categorical", "l_linestatus": "Categorical", "l_shipdate": "DateTime"}


def overview(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return (profile.overview(table(spark, sf_dir, "customer"), "customer", RUN_TS)
            .unionByName(profile.overview(events, "events", RUN_TS)))


def columns(spark, sf_dir):
    return profile.column_stats(wide(spark, sf_dir, "lineitem"), "lineitem", RUN_TS)


def null_counts(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return profile.null_counts(joined)


def descriptive(spark, sf_dir):
    return profile.descriptive(wide(spark, sf_dir, "lineitem", *LINE_NUMBERS), "lineitem", RUN_TS, LINE_NUMBERS, digits=4)


def quantiles(spark, sf_dir):
    found = profile.exact_quantiles(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"], [0.05, 0.5, 0.95])
    return found.select("column_name", *[F.round(F.col("q")[i], 4).alias(n) for i, n in enumerate(["q05", "q50", "q95"])])


def correlations(spark, sf_dir):
    return profile.correlations(table(spark, sf_dir, "lineitem"), "lineitem", RUN_TS, LINE_NUMBERS)


def histogram(spark, sf_dir):
    return profile.histogram(table(spark, sf_dir, "customer"), "c_acctbal", 20)


def top_values(spark, sf_dir):
    return profile.top_values(table(spark, sf_dir, "part"), "p_name")


def inventory(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    stats = profile.column_stats(customer, "customer", RUN_TS)
    found = pii.column_summary(pii.detect(customer, "c_custkey"), customer, "customer", RUN_TS)
    return profile.inventory(stats, found).select(
        "dataset_name", "run_timestamp", "column_name", "column_type", "n_distinct",
        F.coalesce(F.col("is_pii"), F.lit(False)).alias("is_pii"), "detected_entity_types")


QUERIES = {
    "profile_overview": overview, "profile_columns": columns, "profile_null_counts": null_counts,
    "profile_descriptive": descriptive, "profile_quantiles": quantiles, "profile_correlations": correlations,
    "profile_histogram": histogram, "profile_top_values": top_values, "profile_inventory": inventory,
}


def _overview_sql(name: str, source: str, kinds: list[str]) -> str:
    return f"""
        select '{name}' as dataset_name, '{RUN_TS}' as run_timestamp, cast(sum(n) as bigint) as n_rows, {len(kinds)} as n_cols,
               cast(0 as bigint) as n_missing_cells, cast(0.0 as double) as pct_missing_cells, cast(sum(n - 1) as bigint) as n_duplicate_rows,
               cast(round(sum(n - 1) * 100.0 / sum(n), 4) as double) as pct_duplicate_rows,
               count(*) filter (where n > 1) as n_duplicate_groups,
               {kinds.count('Numeric')} as n_numeric_cols, {kinds.count('Categorical')} as n_categorical_cols
        from (select count(*) as n from ({source}) group by all_columns)"""


def _columns_sql(t: str, name: str, kind: str) -> str:
    return f"""
        select '{t}' as dataset_name, '{RUN_TS}' as run_timestamp, '{name}' as column_name, '{kind}' as column_type,
               cast(coalesce(sum(n) filter (where {name} is null), 0) as bigint) as n_missing,
               cast(round(coalesce(sum(n) filter (where {name} is null), 0) * 100.0 / sum(n), 4) as double) as pct_missing,
               count(*) filter (where n = 1 and {name} is not null) as n_unique,
               cast(round(count(*) filter (where n = 1 and {name} is not null) * 100.0 / sum(n), 4) as double) as pct_unique,
               count({name}) as n_distinct
        from (select {name}, count(*) as n from {t} group by {name})"""


def _describe_sql(name: str) -> str:
    return f"""
        select 'lineitem' as dataset_name, '{RUN_TS}' as run_timestamp, '{name}' as column_name, round(avg({name}), 4) as mean,
               round(stddev_samp({name}), 4) as std, round(min({name}), 4) as min,
               round(quantile_cont({name}, 0.25), 4) as pct_25, round(quantile_cont({name}, 0.5), 4) as median,
               round(quantile_cont({name}, 0.75), 4) as pct_75, round(max({name}), 4) as max,
               round(kurtosis({name}), 4) as kurtosis, round(skewness({name}), 4) as skewness from lineitem"""


_PAIRS = [(a, b) for a in sorted(LINE_NUMBERS) for b in sorted(LINE_NUMBERS) if a < b]

ORACLE = {
    "profile_overview": " union all ".join([
        _overview_sql("customer", "select (c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment) as all_columns from customer",
                      list(CUSTOMER_KINDS.values())),
        _overview_sql("events", "select (event_id, ts, user_id, event_type, value, props) as all_columns from events",
                      ["Numeric", "DateTime", "Numeric", "Categorical", "Numeric", "Categorical"])]),
    "profile_columns": " union all ".join(_columns_sql("lineitem", c, k) for c, k in LINE_KINDS.items()),
    "profile_null_counts": """
        with j as (select d.*, quality, toxic from documents d left join labels l on d.doc_id = l.doc_id)
        select 'doc_id' as column_name, count(*) - count(doc_id) as n_missing from j
        union all select 'text', count(*) - count(text) from j
        union all select 'lang', count(*) - count(lang) from j
        union all select 'source', count(*) - count(source) from j
        union all select 'n_chars', count(*) - count(n_chars) from j
        union all select 'quality', count(*) - count(quality) from j
        union all select 'toxic', count(*) - count(toxic) from j""",
    "profile_descriptive": " union all ".join(_describe_sql(c) for c in LINE_NUMBERS),
    "profile_quantiles": " union all ".join(
        f"select '{c}' as column_name, " + ", ".join(
            f"round(quantile_cont(cast({c} as double), {p}), 4) as {n}" for p, n in ((0.05, "q05"), (0.5, "q50"), (0.95, "q95")))
        + " from part" for c in ("p_size", "p_retailprice")),
    "profile_correlations": " union all ".join(
        f"select 'lineitem' as dataset_name, '{RUN_TS}' as run_timestamp, 'pearson' as correlation_type, '{a}' as column_a, "
        f"'{b}' as column_b, round(corr({a}, {b}), 6) as correlation_value from lineitem" for a, b in _PAIRS),
    "profile_histogram": """
        with b as (select min(c_acctbal) as lo, max(c_acctbal) as hi from customer)
        select least(cast(floor((20 * (c_acctbal - lo)) / (hi - lo)) as bigint) + 1, 20) as bin, count(*) as n
        from customer, b group by 1""",
    "profile_top_values": """
        select p_name as value, count(*) as frequency from part group by 1 order by 2 desc, 1 limit 10""",
    "profile_inventory": " union all ".join(
        f"select 'customer' as dataset_name, '{RUN_TS}' as run_timestamp, '{c}' as column_name, '{k}' as column_type, "
        f"count(distinct {c}) as n_distinct, false as is_pii, cast(null as varchar) as detected_entity_types from customer"
        for c, k in CUSTOMER_KINDS.items()),
}
