"""Reconciliation of orders with a target copy derived from them, and of line items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from etlvault.operators import recon
from etlvault.workload.tables import table

RUN_TS = "2024-01-02 00:00:00"
SCALES = {"o_totalprice": 2}
KEY_SHIFT = 10_000_000_000


def _money(df: DataFrame) -> DataFrame:
    return df.withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)"))


def source_orders(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders")


def target_orders(spark, sf_dir) -> DataFrame:
    """A load of orders that lost pending low-priority ones, zeroed small prices, cleared the
    first month's priorities and brought the largest orders in under new keys."""
    orders = source_orders(spark, sf_dir)
    lost = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW")
    price = F.when(F.col("o_totalprice") < 5000, 0.0).otherwise(F.col("o_totalprice"))
    priority = F.when(F.col("o_orderdate") >= F.lit("1995-02-01").cast("timestamp_ntz"), F.col("o_orderpriority"))
    kept = orders.filter(~lost).withColumn("o_totalprice", price).withColumn("o_orderpriority", priority)
    added = orders.filter(F.col("o_totalprice") > 499000).withColumn("o_orderkey", F.col("o_orderkey") + F.lit(KEY_SHIFT))
    return kept.unionByName(added)


def row_count(spark, sf_dir):
    return recon.row_counts(source_orders(spark, sf_dir), target_orders(spark, sf_dir))


def null_counts(spark, sf_dir):
    return recon.null_counts(source_orders(spark, sf_dir), target_orders(spark, sf_dir),
                             ["o_orderkey", "o_orderpriority"])


def checksums(spark, sf_dir):
    found = recon.checksums(_money(source_orders(spark, sf_dir)), _money(target_orders(spark, sf_dir)), ["o_totalprice"])
    return found.select("layer", F.col("sum_o_totalprice").cast("double").alias("sum_o_totalprice"),
                        F.round(F.col("avg_o_totalprice").cast("double"), 3).alias("avg_o_totalprice"))


def aggregates(spark, sf_dir):
    return recon.aggregate_compare(_money(source_orders(spark, sf_dir)), _money(target_orders(spark, sf_dir)),
                                   ["o_totalprice", "o_custkey"])


def missing_keys(spark, sf_dir):
    return recon.missing_keys(source_orders(spark, sf_dir), target_orders(spark, sf_dir), "o_orderkey")


def extra_keys(spark, sf_dir):
    return recon.extra_keys(source_orders(spark, sf_dir), target_orders(spark, sf_dir), "o_orderkey")


def key_check(spark, sf_dir):
    found = recon.key_check(source_orders(spark, sf_dir), target_orders(spark, sf_dir), "o_orderkey")
    return found.withColumn("sample_missing", F.array_join("sample_missing", ",")).withColumn(
        "sample_extra", F.array_join("sample_extra", ","))


def duplicate_keys(spark, sf_dir):
    return recon.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def duplicate_listing(spark, sf_dir):
    return recon.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], recon.LISTING_LIMIT)


def value_mismatch(spark, sf_dir):
    return recon.value_mismatches(source_orders(spark, sf_dir).withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)")),
                                  _money(target_orders(spark, sf_dir)), "o_orderkey")


def mismatch_types(spark, sf_dir):
    return recon.mismatch_types(recon.value_mismatches(
        source_orders(spark, sf_dir), target_orders(spark, sf_dir), "o_orderkey"))


def row_hash(spark, sf_dir):
    return recon.hash_mismatches(source_orders(spark, sf_dir), target_orders(spark, sf_dir), "o_orderkey", scales=SCALES)


def value_check(spark, sf_dir):
    found = recon.value_check(_money(source_orders(spark, sf_dir)), _money(target_orders(spark, sf_dir)), "o_orderkey")
    listed = F.transform("sample_mismatches", lambda m: F.concat_ws("|", m["key"], m["column"], F.coalesce(m["source_value"], F.lit("-")),
                                                                    F.coalesce(m["target_value"], F.lit("-")), m["mismatch_type"]))
    return found.withColumn("sample_mismatches", F.array_join(listed, ";"))


def hash_check(spark, sf_dir):
    found = recon.hash_check(source_orders(spark, sf_dir), target_orders(spark, sf_dir), "o_orderkey", scales=SCALES)
    return found.withColumn("sample_diff_keys", F.array_join("sample_diff_keys", ","))


def delta_counts(spark, sf_dir):
    since, until = "1998-01-01", "1999-01-01"
    return recon.row_counts(recon.delta(source_orders(spark, sf_dir), "o_orderdate", since, until),
                            recon.delta(target_orders(spark, sf_dir), "o_orderdate", since, until))


def _report(spark, sf_dir):
    return recon.reconcile(_money(source_orders(spark, sf_dir)), _money(target_orders(spark, sf_dir)), "o_orderkey",
                           ["o_totalprice"], RUN_TS, scales=SCALES)


def report(spark, sf_dir):
    return _report(spark, sf_dir).select(
        "check", "source_value", F.coalesce("target_value", F.lit(-1.0)).alias("target_value"),
        F.coalesce("abs_diff", F.lit(-1.0)).alias("abs_diff"), "status")


def summary(spark, sf_dir):
    return recon.summarise(_report(spark, sf_dir))


QUERIES = {
    "recon_row_count": row_count, "recon_null_counts": null_counts, "recon_checksums": checksums,
    "recon_aggregates": aggregates, "recon_missing_keys": missing_keys, "recon_extra_keys": extra_keys,
    "recon_key_check": key_check, "recon_duplicate_keys": duplicate_keys,
    "recon_duplicate_listing": duplicate_listing, "recon_value_mismatch": value_mismatch,
    "recon_mismatch_types": mismatch_types, "recon_row_hash": row_hash,
    "recon_value_check": value_check, "recon_hash_check": hash_check, "recon_delta": delta_counts,
    "recon_report": report, "recon_summary": summary,
}

TARGET_SQL = f"""
tgt as (
  select o_orderkey, o_custkey, o_orderstatus, case when o_totalprice < 5000 then 0.0 else o_totalprice end as o_totalprice,
         o_orderdate, case when o_orderdate >= timestamp '1995-02-01' then o_orderpriority end as o_orderpriority
  from orders where not (o_orderstatus = 'P' and o_orderpriority = '5-LOW')
  union all
  select o_orderkey + {KEY_SHIFT}, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
  from orders where o_totalprice > 499000)"""

_COUNT = """
  select 'ROW_COUNT' as "check", s as source_count, t as target_count, s - t as difference,
         round(abs(s - t) * 100.0 / s, 4) as pct_difference, case when s = t then 'PASS' else 'FAIL' end as status,
         case when s = t then 'Row counts match.'
              when s > t then cast(s - t as varchar) || ' rows missing in target. Check filters, rejected records and truncation.'
              else cast(t - s as varchar) || ' rows extra in target. Check filters, rejected records and truncation.' end as recommendation
  from (select (select count(*) from {a}) as s, (select count(*) from {b}) as t)"""

_CELLS = f"""
{TARGET_SQL}, cells as (
  select cast(s.o_orderkey as varchar) as key, unnest([
    {{'c': 'o_custkey', 's': cast(s.o_custkey as varchar), 't': cast(t.o_custkey as varchar)}},
    {{'c': 'o_orderstatus', 's': s.o_orderstatus, 't': t.o_orderstatus}},
    {{'c': 'o_totalprice', 's': cast(cast(s.o_totalprice as decimal(18,2)) as varchar), 't': cast(cast(t.o_totalprice as decimal(18,2)) as varchar)}},
    {{'c': 'o_orderdate', 's': cast(s.o_orderdate as varchar), 't': cast(t.o_orderdate as varchar)}},
    {{'c': 'o_orderpriority', 's': s.o_orderpriority, 't': t.o_orderpriority}}]) as x
  from orders s join tgt t using (o_orderkey)),
diff as (
  select key, x.c as "column", x.s as source_value, x.t as target_value,
         case when (x.s is null) <> (x.t is null) then 'NULL_DIFFERENCE' else 'VALUE_DIFFERENCE' end as mismatch_type
  from cells where x.s is distinct from x.t)"""

_HASHED = f"""
{TARGET_SQL}, hashed as (
  select cast(s.o_orderkey as varchar) as key, {{s}} as source_hash, {{t}} as target_hash
  from orders s join tgt t using (o_orderkey))"""


def _digest(a: str) -> str:
    return (f"md5(cast({a}.o_custkey as varchar) || '|' || cast({a}.o_orderdate as varchar) || '|' || coalesce({a}.o_orderpriority, 'None')"
            f" || '|' || {a}.o_orderstatus || '|' || cast(cast({a}.o_totalprice as decimal(18,2)) as varchar))")


_HASHED = _HASHED.format(s=_digest("s"), t=_digest("t"))

_AGG = f"""
{TARGET_SQL}, m as (
  select c, a, s, t, abs(s - t) as d, case when s <> 0 then abs(s - t) / abs(s) * 100 when t = 0 then 0.0 else 100.0 end as p from (
    select 'o_totalprice' as c, 'SUM' as a,
           (select cast(sum(cast(o_totalprice as decimal(18,2))) as double) from orders) as s,
           (select cast(sum(cast(o_totalprice as decimal(18,2))) as double) from tgt) as t
    union all select 'o_totalprice', 'AVG',
           (select cast(sum(cast(o_totalprice as decimal(18,2))) as double) / count(o_totalprice) from orders),
           (select cast(sum(cast(o_totalprice as decimal(18,2))) as double) / count(o_totalprice) from tgt)
    union all select 'o_totalprice', 'COUNT', (select cast(count(o_totalprice) as double) from orders), (select cast(count(o_totalprice) as double) from tgt)
    union all select 'o_custkey', 'SUM', (select cast(sum(o_custkey) as double) from orders), (select cast(sum(o_custkey) as double) from tgt)
    union all select 'o_custkey', 'AVG', (select cast(sum(o_custkey) as double) / count(*) from orders), (select cast(sum(o_custkey) as double) / count(*) from tgt)
    union all select 'o_custkey', 'COUNT', (select cast(count(o_custkey) as double) from orders), (select cast(count(o_custkey) as double) from tgt)))"""

_KEYS = f"""
{TARGET_SQL},
lost as (select cast(o_orderkey as varchar) as key from orders where o_orderkey not in (select o_orderkey from tgt)),
added as (select cast(o_orderkey as varchar) as key from tgt where o_orderkey not in (select o_orderkey from orders))"""

_REPORT = f"""
{_AGG.strip()},
lost as (select o_orderkey as key from orders where o_orderkey not in (select o_orderkey from tgt)),
added as (select o_orderkey as key from tgt where o_orderkey not in (select o_orderkey from orders)),
pairs as (
  select (s.o_custkey is distinct from t.o_custkey)::int + (s.o_orderstatus is distinct from t.o_orderstatus)::int
       + (s.o_totalprice is distinct from t.o_totalprice)::int + (s.o_orderdate is distinct from t.o_orderdate)::int
       + (s.o_orderpriority is distinct from t.o_orderpriority)::int as n,
       {_digest('s')} as hs, {_digest('t')} as ht
  from orders s join tgt t using (o_orderkey)),
r as (
  select 'ROW_COUNT' as "check", (select count(*) from orders)::double as source_value, (select count(*) from tgt)::double as target_value,
         abs((select count(*) from orders) - (select count(*) from tgt))::double as abs_diff,
         case when (select count(*) from orders) = (select count(*) from tgt) then 'PASS' else 'FAIL' end as status
  union all select 'MISSING_KEYS', (select count(*) from lost)::double, (select count(*) from added)::double, -1.0,
         case when (select count(*) from lost) + (select count(*) from added) = 0 then 'PASS' else 'FAIL' end
  union all select 'AGGREGATE_' || a, round(s, 4), round(t, 4), round(d, 4), case when p <= 0.001 then 'PASS' else 'FAIL' end
         from m where c = 'o_totalprice'
  union all select 'VALUE_MISMATCH', count(*)::double, -1.0, sum(n)::double, case when sum(n) = 0 then 'PASS' else 'FAIL' end from pairs
  union all select 'HASH_COMPARISON', count(*)::double, -1.0, count(*) filter (where hs <> ht)::double,
         case when count(*) filter (where hs <> ht) = 0 then 'PASS' else 'FAIL' end from pairs)"""

ORACLE = {
    "recon_row_count": f"with {TARGET_SQL} {_COUNT.format(a='orders', b='tgt')}",
    "recon_null_counts": f"""with {TARGET_SQL}
        select 'SOURCE' as layer, count(*) as row_count, count(*) - count(o_orderkey) as null_o_orderkey_count,
               count(*) - count(o_orderpriority) as null_o_orderpriority_count from orders
        union all select 'TARGET', count(*), count(*) - count(o_orderkey), count(*) - count(o_orderpriority) from tgt""",
    "recon_checksums": f"""with {TARGET_SQL}
        select 'SOURCE' as layer, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as sum_o_totalprice,
               round(cast(sum(cast(o_totalprice as decimal(18,2))) as double) / count(o_totalprice), 3) as avg_o_totalprice from orders
        union all select 'TARGET', cast(sum(cast(o_totalprice as decimal(18,2))) as double),
               round(cast(sum(cast(o_totalprice as decimal(18,2))) as double) / count(o_totalprice), 3) from tgt""",
    "recon_aggregates": f"""with {_AGG}
        select 'AGGREGATE_' || a as "check", c as "column", a as aggregate, round(s, 4) as source_value, round(t, 4) as target_value,
               round(d, 4) as abs_diff, round(p, 6) as pct_diff, cast(0.001 as double) as tolerance_pct,
               case when p <= 0.001 then 'PASS' else 'FAIL' end as status,
               case when p <= 0.001 then a || '(' || c || ') matches within tolerance.'
                    else a || '(' || c || ') is outside the tolerance. Check NULL handling, rounding and missing rows.' end as recommendation
        from m""",
    "recon_missing_keys": f"with {_KEYS} select key from lost",
    "recon_extra_keys": f"with {_KEYS} select key from added",
    "recon_key_check": f"""with {_KEYS}, n as (select (select count(*) from lost) as m, (select count(*) from added) as x)
        select 'MISSING_KEYS' as "check", m as missing_in_target, x as extra_in_target,
               (select coalesce(string_agg(key, ',' order by key), '') from (select key from lost order by key limit 10)) as sample_missing,
               (select coalesce(string_agg(key, ',' order by key), '') from (select key from added order by key limit 10)) as sample_extra,
               case when m + x = 0 then 'PASS' else 'FAIL' end as status,
               case when m + x = 0 then 'All keys matched.' else cast(m as varchar) || ' keys missing in target, ' || cast(x as varchar)
                    || ' extra. Check load failures, key generation and stale data.' end as recommendation
        from n""",
    "recon_duplicate_keys": """
        select l_orderkey, l_linenumber, count(*) as duplicate_count from lineitem
        group by all having count(*) > 1""",
    "recon_duplicate_listing": """
        select l_orderkey, l_linenumber, count(*) as duplicate_count from lineitem
        group by l_orderkey, l_linenumber having count(*) > 1 order by l_orderkey, l_linenumber limit 100""",
    "recon_value_mismatch": f"with {_CELLS} select * from diff",
    "recon_mismatch_types": f'with {_CELLS} select "column", mismatch_type, count(*) as cells from diff group by all',
    "recon_row_hash": f"with {_HASHED} select * from hashed where source_hash <> target_hash",
    "recon_value_check": f"""with {_CELLS},
        n as (select count(*) as k from diff),
        first as (select key || '|' || "column" || '|' || coalesce(source_value, '-') || '|' || coalesce(target_value, '-') || '|' || mismatch_type as line,
                    key, "column" as c from diff order by key, "column" limit 20)
        select 'VALUE_MISMATCH' as "check", (select count(*) from orders join tgt using (o_orderkey)) as rows_compared, k as mismatches_found,
               (select coalesce(string_agg(line, ';' order by key, c), '') from first) as sample_mismatches, case when k = 0 then 'PASS' else 'FAIL' end as status,
               case when k = 0 then 'All values matched for compared rows.'
                    else cast(k as varchar) || ' value mismatches found. Review the transformation of the affected columns.' end as recommendation
        from n""",
    "recon_hash_check": f"""with {_HASHED},
        n as (select count(*) as c, count(*) filter (where source_hash <> target_hash) as k from hashed)
        select 'HASH_COMPARISON' as "check", c as rows_compared, k as hash_mismatches,
               (select coalesce(string_agg(key, ',' order by key), '') from (
                  select key from hashed where source_hash <> target_hash order by key limit 10)) as sample_diff_keys,
               case when k = 0 then 'PASS' else 'FAIL' end as status,
               case when k = 0 then 'All row hashes matched.'
                    else cast(k as varchar) || ' rows have differing hashes. Run the value check to find the columns.' end as recommendation
        from n""",
    "recon_delta": f"""with {TARGET_SQL},
        s98 as (select 1 from orders where o_orderdate >= timestamp '1998-01-01' and o_orderdate < timestamp '1999-01-01'),
        t98 as (select 1 from tgt where o_orderdate >= timestamp '1998-01-01' and o_orderdate < timestamp '1999-01-01')
        {_COUNT.format(a='s98', b='t98')}""",
    "recon_report": f"with {_REPORT} select * from r",
    "recon_summary": f"""with {_REPORT} select count(*) as total_checks, count(*) filter (where status = 'PASS') as passed,
        count(*) filter (where status = 'FAIL') as failed, count(*) filter (where status = 'SKIPPED') as skipped from r""",
}
