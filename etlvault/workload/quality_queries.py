"""Quality rules over customer, orders, events and the order references."""

from __future__ import annotations

from pyspark.sql import functions as F

from etlvault.operators import quality
from etlvault.workload.tables import table

AS_OF = "2001-01-01"
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]


def _rule(i, dimension, column, check, threshold=0, **extra):
    return {"rule_id": f"DQ_{i:04d}", "dimension": dimension, "column": column, "check_type": check,
            "threshold": threshold, **extra}


CUSTOMER_RULES = [
    _rule(1, "COMPLETENESS", "C_CUSTKEY", "NOT_NULL"),
    _rule(2, "UNIQUENESS", "c_custkey", "UNIQUE"),
    _rule(3, "UNIQUENESS", "c_nationkey", "UNIQUE"),
    _rule(4, "VALIDITY", "c_name", "REGEX", pattern="Customer#[0-9]{8}[0-4]$"),
    _rule(5, "ACCURACY", "c_acctbal", "RANGE", min_value=0),
    _rule(6, "ACCURACY", "c_acctbal", "RANGE", min_value=-1000, max_value=10000),
    _rule(7, "VALIDITY", "c_mktsegment", "STRING_LENGTH", max_length=8),
    _rule(8, "CONSISTENCY", "c_nationkey", "REFERENTIAL_INTEGRITY", ref_table="nation", ref_column="n_nationkey"),
    _rule(9, "COMPLETENESS", "c_phone", "NOT_NULL"),
    _rule(10, "CONSISTENCY", "c_custkey", "REFERENTIAL_INTEGRITY", ref_table="unknown", ref_column="x"),
]
ORDER_RULES = [
    _rule(11, "TIMELINESS", "o_orderdate", "DATE_RANGE", min_date="1996-01-01", max_date=AS_OF),
    _rule(12, "TIMELINESS", "o_orderdate", "NO_FUTURE_DATES", as_of=AS_OF),
    _rule(13, "VALIDITY", "o_orderpriority", "ACCEPTED_VALUES", values=PRIORITIES),
    _rule(14, "VALIDITY", "o_orderpriority", "DATE_FORMAT", format="yyyy-MM-dd"),
    _rule(15, "ACCURACY", "o_orderpriority", "RANGE", min_value=0),
    _rule(16, "UNIQUENESS", "o_orderkey", "UNIQUE"),
]


def _results(spark, sf_dir):
    customer = quality.evaluate(table(spark, sf_dir, "customer"), CUSTOMER_RULES, "customer",
                                {"nation": table(spark, sf_dir, "nation")})
    return customer.unionByName(quality.evaluate(table(spark, sf_dir, "orders"), ORDER_RULES, "orders"))


def evaluate(spark, sf_dir):
    return _results(spark, sf_dir).drop("note")


def by_dimension(spark, sf_dir):
    return quality.by_dimension(_results(spark, sf_dir))


def summary(spark, sf_dir):
    return quality.summarise(_results(spark, sf_dir))


def failed(spark, sf_dir):
    return quality.failed(_results(spark, sf_dir)).select("rule_id", "table", "column", "actual_failures")


def referential(spark, sf_dir):
    """Order lines whose order is not among the closed ones."""
    closed = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "F")
    return quality.orphans(table(spark, sf_dir, "lineitem"), "l_orderkey", closed, "o_orderkey")


def accepted_values(spark, sf_dir):
    """Values of the order priority that the early orders did not use, learned as a baseline."""
    orders = table(spark, sf_dir, "orders")
    early = orders.filter((F.col("o_orderdate") < F.lit("1995-03-01").cast("timestamp_ntz")) & (F.col("o_orderstatus") == "P"))
    rule = _rule(1, "VALIDITY", "o_orderpriority", "ACCEPTED_VALUES", ref_table="early", ref_column="o_orderpriority")
    return quality.evaluate(orders, [rule], "orders", {"early": early}).drop("note")


def unique_listing(spark, sf_dir):
    from etlvault.operators.recon import duplicate_keys
    return duplicate_keys(table(spark, sf_dir, "events"), ["user_id", "event_type"])


def row_flags(spark, sf_dir):
    """Every order with the number of scalar rules it breaks."""
    orders = table(spark, sf_dir, "orders")
    broken = F.lit(0)
    for rule in ORDER_RULES:
        test = quality.failure(orders, rule["column"], rule)
        if test is not None:
            broken = broken + test.cast("int")
    return orders.select("o_orderkey", broken.alias("broken_rules")).filter("broken_rules > 0")


QUERIES = {
    "dq_evaluate": evaluate, "dq_by_dimension": by_dimension, "dq_summary": summary, "dq_failed": failed,
    "dq_referential": referential, "dq_accepted_values": accepted_values, "dq_unique_listing": unique_listing,
    "dq_row_flags": row_flags,
}

_IN = ", ".join(f"'{p}'" for p in PRIORITIES)
_RES = f"""
c as (select count(*) as n, count(*) filter (where c_custkey is null) as f1, count(*) - count(distinct c_custkey) as f2,
        count(*) - count(distinct c_nationkey) as f3,
        count(*) filter (where not regexp_matches(c_name, '^Customer#[0-9]{{8}}[0-4]$')) as f4,
        count(*) filter (where c_acctbal < 0) as f5, count(*) filter (where c_acctbal < -1000 or c_acctbal > 10000) as f6,
        count(*) filter (where length(c_mktsegment) > 8) as f7,
        count(*) filter (where c_nationkey not in (select n_nationkey from nation)) as f8 from customer),
o as (select count(*) as n, count(*) filter (where o_orderdate < timestamp '1996-01-01' or o_orderdate > timestamp '{AS_OF}') as f11,
        count(*) filter (where o_orderdate > timestamp '{AS_OF}') as f12,
        count(*) filter (where o_orderpriority not in ({_IN})) as f13,
        count(*) filter (where o_orderpriority is not null) as f14, 0 as f15,
        count(*) - count(distinct o_orderkey) as f16 from orders),
m as (
  select 'DQ_0001' as rule_id, 'COMPLETENESS' as dimension, 'customer' as t, 'C_CUSTKEY' as c, 'NOT_NULL' as k, n, f1 as f, null as preset from c
  union all select 'DQ_0002', 'UNIQUENESS', 'customer', 'c_custkey', 'UNIQUE', n, f2, null from c
  union all select 'DQ_0003', 'UNIQUENESS', 'customer', 'c_nationkey', 'UNIQUE', n, f3, null from c
  union all select 'DQ_0004', 'VALIDITY', 'customer', 'c_name', 'REGEX', n, f4, null from c
  union all select 'DQ_0005', 'ACCURACY', 'customer', 'c_acctbal', 'RANGE', n, f5, null from c
  union all select 'DQ_0006', 'ACCURACY', 'customer', 'c_acctbal', 'RANGE', n, f6, null from c
  union all select 'DQ_0007', 'VALIDITY', 'customer', 'c_mktsegment', 'STRING_LENGTH', n, f7, null from c
  union all select 'DQ_0008', 'CONSISTENCY', 'customer', 'c_nationkey', 'REFERENTIAL_INTEGRITY', n, f8, null from c
  union all select 'DQ_0009', 'COMPLETENESS', 'customer', 'c_phone', 'NOT_NULL', 0, 0, 'SKIPPED'
  union all select 'DQ_0010', 'CONSISTENCY', 'customer', 'c_custkey', 'REFERENTIAL_INTEGRITY', 0, 0, 'SKIPPED'
  union all select 'DQ_0011', 'TIMELINESS', 'orders', 'o_orderdate', 'DATE_RANGE', n, f11, null from o
  union all select 'DQ_0012', 'TIMELINESS', 'orders', 'o_orderdate', 'NO_FUTURE_DATES', n, f12, null from o
  union all select 'DQ_0013', 'VALIDITY', 'orders', 'o_orderpriority', 'ACCEPTED_VALUES', n, f13, null from o
  union all select 'DQ_0014', 'VALIDITY', 'orders', 'o_orderpriority', 'DATE_FORMAT', n, f14, null from o
  union all select 'DQ_0015', 'ACCURACY', 'orders', 'o_orderpriority', 'RANGE', n, f15, null from o
  union all select 'DQ_0016', 'UNIQUENESS', 'orders', 'o_orderkey', 'UNIQUE', n, f16, null from o),
res as (
  select rule_id, dimension, t as "table", c as "column", k as check_type, cast(0 as bigint) as threshold, n as rows_checked,
         f as actual_failures, case when n > 0 then round((n - f) * 100.0 / n, 2) else 100.0 end as pass_rate,
         coalesce(preset, case when f <= 0 then 'PASS' else 'FAIL' end) as status from m)"""

ORACLE = {
    "dq_evaluate": f"with {_RES} select * replace (cast(pass_rate as double) as pass_rate) from res",
    "dq_by_dimension": f"with {_RES} select dimension, status, count(*) as rules from res group by all",
    "dq_summary": f"""with {_RES} select count(*) as total_rules, count(*) filter (where status = 'PASS') as passed,
        count(*) filter (where status = 'FAIL') as failed, count(*) filter (where status = 'SKIPPED') as skipped,
        cast(0 as bigint) as errored,
        cast(round(count(*) filter (where status = 'PASS') * 100.0 / count(*) filter (where status in ('PASS', 'FAIL')), 2) as double) as overall_pass_pct
        from res""",
    "dq_failed": f"""with {_RES} select rule_id, "table", "column", actual_failures from res where status = 'FAIL'""",
    "dq_referential": """
        select cast(l_orderkey as varchar) as key, count(*) as child_rows from lineitem
        where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F') group by l_orderkey""",
    "dq_accepted_values": """
        with known as (select distinct o_orderpriority as v from orders where o_orderdate < timestamp '1995-03-01' and o_orderstatus = 'P'),
        r as (select count(*) as n, count(*) filter (where o_orderpriority not in (select v from known)) as f from orders)
        select 'DQ_0001' as rule_id, 'VALIDITY' as dimension, 'orders' as "table", 'o_orderpriority' as "column", 'ACCEPTED_VALUES' as check_type,
               cast(0 as bigint) as threshold, n as rows_checked, f as actual_failures, cast(round((n - f) * 100.0 / n, 2) as double) as pass_rate,
               case when f = 0 then 'PASS' else 'FAIL' end as status from r""",
    "dq_unique_listing": """
        select user_id, event_type, count(*) as duplicate_count from events group by all having count(*) > 1""",
    "dq_row_flags": f"""
        select * from (
          select o_orderkey, (o_orderdate < timestamp '1996-01-01' or o_orderdate > timestamp '{AS_OF}')::int
               + (o_orderdate > timestamp '{AS_OF}')::int + (o_orderpriority not in ({_IN}))::int
               + (o_orderpriority is not null)::int as broken_rules from orders)
        where broken_rules > 0""",
}
