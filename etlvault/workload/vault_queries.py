"""Data Vault queries over customer, orders, lineitem and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from etlvault.functions.hashing import hash_key, normalised_key
from etlvault.operators import vault
from etlvault.workload.tables import table, wide

DAY_1, DAY_2 = "2024-01-01 00:00:00", "2024-01-02 00:00:00"
MONEY = {"o_totalprice": 2, "c_acctbal": 2}
ORDER_PAYLOAD = ["o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
CUSTOMER_PAYLOAD = ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
SNAPSHOTS = ["2024-01-05 00:00:00", "2024-01-15 00:00:00", "2024-02-01 00:00:00"]


def _text(df: DataFrame, *names: str) -> DataFrame:
    for name in names:
        df = df.withColumn(name, F.col(name).cast("string"))
    return df


def staged_orders(spark, sf_dir, load_date=DAY_1, orders=None) -> DataFrame:
    orders = wide(spark, sf_dir, "orders") if orders is None else orders
    return vault.stage(
        orders,
        {"ORDER_HK": ["o_orderkey"], "CUSTOMER_HK": ["o_custkey"],
         "LNK_CUSTOMER_ORDER_HK": ["o_custkey", "o_orderkey"]},
        load_date, "OMS.ORDERS", {"ORDER_HASHDIFF": ORDER_PAYLOAD}, scales=MONEY)


def staged_customer(spark, sf_dir) -> DataFrame:
    return vault.stage(table(spark, sf_dir, "customer"), {"CUSTOMER_HK": ["c_custkey"]},
                       DAY_1, "CRM.CUSTOMER", {"CUSTOMER_HASHDIFF": CUSTOMER_PAYLOAD}, scales=MONEY)


def staged_events(spark, sf_dir) -> DataFrame:
    return vault.stage(wide(spark, sf_dir, "events", "user_id", "ts", "event_type"), {"USER_HK": ["user_id"]}, F.col("ts"),
                       "WEB.EVENTS", {"EVENT_HASHDIFF": ["event_type"]})


def stage_orders(spark, sf_dir):
    return _text(staged_orders(spark, sf_dir).select(
        "o_orderkey", "ORDER_HK", "CUSTOMER_HK", "LNK_CUSTOMER_ORDER_HK", "ORDER_HASHDIFF",
        "LOAD_DATE", "RECORD_SOURCE"), "LOAD_DATE")


def hub_customer(spark, sf_dir):
    """Customer keys seen in two sources; the first record by load date and source stays."""
    names = ["CUSTOMER_HK", "CUSTOMER_BK", "LOAD_DATE", "RECORD_SOURCE"]
    both = (staged_customer(spark, sf_dir).withColumnRenamed("c_custkey", "CUSTOMER_BK").select(names)
            .unionByName(staged_orders(spark, sf_dir).withColumnRenamed("o_custkey", "CUSTOMER_BK").select(names)))
    return _text(vault.load_hub(both, "CUSTOMER_HK", ["CUSTOMER_BK"]), "LOAD_DATE")


def hub_order(spark, sf_dir):
    return _text(vault.load_hub_batch(table(spark, sf_dir, "orders"), "ORDER_HK", ["o_orderkey"], DAY_1, "OMS.ORDERS"), "LOAD_DATE")


def _link_customer_order(spark, sf_dir):
    return vault.load_link_batch(table(spark, sf_dir, "orders"), "LNK_CUSTOMER_ORDER_HK",
                                 {"CUSTOMER_HK": ["o_custkey"], "ORDER_HK": ["o_orderkey"]}, DAY_1, "OMS.ORDERS")


def link_customer_order(spark, sf_dir):
    return _text(_link_customer_order(spark, sf_dir), "LOAD_DATE")


def link_lineitem(spark, sf_dir):
    return _text(vault.load_link_batch(
        table(spark, sf_dir, "lineitem"), "LNK_HK",
        {"ORDER_HK": ["l_orderkey"], "PART_HK": ["l_partkey"], "SUPPLIER_HK": ["l_suppkey"]}, DAY_1, "OMS.LINEITEM"), "LOAD_DATE")


def _sat_order(spark, sf_dir):
    return vault.load_satellite(staged_orders(spark, sf_dir), "ORDER_HK", "ORDER_HASHDIFF", ORDER_PAYLOAD)


def sat_order(spark, sf_dir):
    return _text(_sat_order(spark, sf_dir), "LOAD_DATE", "o_orderdate")


def sat_incremental(spark, sf_dir):
    """Second load of all orders: those from 2000 on were closed meanwhile."""
    orders = wide(spark, sf_dir, "orders").withColumn(
        "o_orderstatus",
        F.when(F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz"), "F")
        .otherwise(F.col("o_orderstatus")))
    second = staged_orders(spark, sf_dir, DAY_2, orders)
    dates = second.select("LOAD_DATE").unionByName(staged_orders(spark, sf_dir).select("LOAD_DATE"))
    return _text(vault.load_satellite(second, "ORDER_HK", "ORDER_HASHDIFF", ORDER_PAYLOAD,
                                      stored=_sat_order(spark, sf_dir), dates=dates), "LOAD_DATE", "o_orderdate")


def _sat_event(spark, sf_dir):
    return vault.load_satellite(staged_events(spark, sf_dir), "USER_HK", "EVENT_HASHDIFF", ["event_type"])


def sat_history(spark, sf_dir):
    return _text(_sat_event(spark, sf_dir), "LOAD_DATE")


def sat_end_dated(spark, sf_dir):
    return _text(vault.end_dated(_sat_event(spark, sf_dir), "USER_HK", dates=staged_events(spark, sf_dir)), "LOAD_DATE", "LOAD_END_DATE")


def pit(spark, sf_dir):
    hub = vault.load_hub(staged_events(spark, sf_dir), "USER_HK", ["user_id"])
    return _text(vault.point_in_time(hub, {"SAT_EVENT_LDTS": _sat_event(spark, sf_dir)}, "USER_HK", SNAPSHOTS),
                 "SNAPSHOT_DATE", "SAT_EVENT_LDTS")


def ghost(spark, sf_dir):
    sat = vault.load_satellite(staged_customer(spark, sf_dir), "CUSTOMER_HK", "CUSTOMER_HASHDIFF", ["c_mktsegment"])
    return _text(vault.with_ghost(sat, ["CUSTOMER_HK", "CUSTOMER_HASHDIFF"]), "LOAD_DATE")


def key_checks(spark, sf_dir):
    items = vault.stage(wide(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber"), {"LINE_HK": ["l_orderkey", "l_linenumber"]},
                        DAY_1, "OMS.LINEITEM")
    orders = staged_orders(spark, sf_dir)
    return vault.key_checks({
        "HUB_ORDER": (orders, "ORDER_HK", ["ORDER_HK", "o_orderkey"]),
        "LNK_CUSTOMER_ORDER": (orders, "LNK_CUSTOMER_ORDER_HK", ["CUSTOMER_HK", "ORDER_HK"]),
        "HUB_LINE": (items, "LINE_HK", ["LINE_HK"]),
        "SAT_ORDER": (orders, "", ["ORDER_HK", "LOAD_DATE"]),
    })


def sha256_key(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        "c_custkey", hash_key(["c_custkey", "c_mktsegment"], "sha256").alias("hk_sha256"),
        normalised_key(["c_name", "c_mktsegment"]).alias("hk_normalised"))


def order_360(spark, sf_dir):
    """Stage, load hubs, link and satellites, then join them back: value per market segment."""
    orders, customers = staged_orders(spark, sf_dir), staged_customer(spark, sf_dir)
    hub_c = vault.load_hub_batch(table(spark, sf_dir, "customer"), "CUSTOMER_HK", ["c_custkey"], DAY_1, "CRM.CUSTOMER")
    sat_c = vault.load_satellite(customers, "CUSTOMER_HK", "CUSTOMER_HASHDIFF", ["c_mktsegment"], bucket=None)
    link = _link_customer_order(spark, sf_dir)
    sat_o = vault.load_satellite(orders, "ORDER_HK", "ORDER_HASHDIFF", ["o_orderstatus", "o_totalprice"], bucket=None)
    kept = sat_o.filter(F.col("o_orderstatus").isin("F", "O") & (F.col("o_totalprice") > 0))
    # value per customer first: a customer with most of the orders is one row in the next join
    value = (
        link.select("CUSTOMER_HK", "ORDER_HK").join(kept.select("ORDER_HK", "o_totalprice"), "ORDER_HK")
        .groupBy("CUSTOMER_HK").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("v"))
    )
    return (
        value.join(hub_c.select("CUSTOMER_HK"), "CUSTOMER_HK").join(sat_c.select("CUSTOMER_HK", "c_mktsegment"), "CUSTOMER_HK")
        .groupBy("c_mktsegment")
        .agg(F.count("*").alias("customers"), F.sum("n").alias("orders"), F.sum("v").cast("double").alias("total_value"))
    )


QUERIES = {
    "vault_stage_orders": stage_orders, "vault_hub_customer": hub_customer, "vault_hub_order": hub_order,
    "vault_link_customer_order": link_customer_order, "vault_link_lineitem": link_lineitem,
    "vault_sat_order": sat_order, "vault_sat_incremental": sat_incremental,
    "vault_sat_history": sat_history, "vault_sat_end_dated": sat_end_dated, "vault_pit": pit,
    "vault_ghost": ghost, "vault_key_checks": key_checks, "vault_sha256_key": sha256_key,
    "vault_order_360": order_360,
}

_DIFF = ("md5(coalesce({status},'') || '||' || coalesce(cast(cast(o_totalprice as decimal(18,2)) as varchar),'')"
         " || '||' || coalesce(cast(o_orderdate as varchar),'') || '||' || coalesce(o_orderpriority,''))")
_SAT_EVENT = """
sat as (
  select USER_HK, LOAD_DATE, RECORD_SOURCE, EVENT_HASHDIFF, event_type from (
    select *, lag(EVENT_HASHDIFF) over (partition by USER_HK order by LOAD_DATE) as before from (
      select md5(cast(user_id as varchar)) as USER_HK, ts as LOAD_DATE, 'WEB.EVENTS' as RECORD_SOURCE,
             md5(coalesce(event_type,'')) as EVENT_HASHDIFF, event_type,
             row_number() over (partition by user_id, ts order by md5(coalesce(event_type,''))) as rn
      from events) where rn = 1)
  where before is null or before <> EVENT_HASHDIFF)
"""

ORACLE = {
    "vault_stage_orders": f"""
        select o_orderkey, md5(cast(o_orderkey as varchar)) as ORDER_HK, md5(cast(o_custkey as varchar)) as CUSTOMER_HK,
               md5(cast(o_custkey as varchar) || '||' || cast(o_orderkey as varchar)) as LNK_CUSTOMER_ORDER_HK,
               {_DIFF.format(status='o_orderstatus')} as ORDER_HASHDIFF,
               '{DAY_1}' as LOAD_DATE, 'OMS.ORDERS' as RECORD_SOURCE
        from orders""",
    "vault_hub_customer": f"""
        select md5(cast(k as varchar)) as CUSTOMER_HK, k as CUSTOMER_BK, '{DAY_1}' as LOAD_DATE, min(s) as RECORD_SOURCE
        from (select c_custkey as k, 'CRM.CUSTOMER' as s from customer
              union all select o_custkey, 'OMS.ORDERS' from orders) group by k""",
    "vault_hub_order": f"""
        select distinct md5(cast(o_orderkey as varchar)) as ORDER_HK, o_orderkey, '{DAY_1}' as LOAD_DATE,
               'OMS.ORDERS' as RECORD_SOURCE from orders""",
    "vault_link_customer_order": f"""
        select distinct md5(cast(o_custkey as varchar) || '||' || cast(o_orderkey as varchar)) as LNK_CUSTOMER_ORDER_HK,
               md5(cast(o_custkey as varchar)) as CUSTOMER_HK, md5(cast(o_orderkey as varchar)) as ORDER_HK,
               '{DAY_1}' as LOAD_DATE, 'OMS.ORDERS' as RECORD_SOURCE from orders""",
    "vault_link_lineitem": f"""
        select distinct md5(cast(l_orderkey as varchar) || '||' || cast(l_partkey as varchar) || '||' || cast(l_suppkey as varchar)) as LNK_HK,
               md5(cast(l_orderkey as varchar)) as ORDER_HK, md5(cast(l_partkey as varchar)) as PART_HK,
               md5(cast(l_suppkey as varchar)) as SUPPLIER_HK, '{DAY_1}' as LOAD_DATE, 'OMS.LINEITEM' as RECORD_SOURCE
        from lineitem""",
    "vault_sat_order": f"""
        select md5(cast(o_orderkey as varchar)) as ORDER_HK, '{DAY_1}' as LOAD_DATE, 'OMS.ORDERS' as RECORD_SOURCE,
               {_DIFF.format(status='o_orderstatus')} as ORDER_HASHDIFF, o_orderstatus, o_totalprice,
               cast(o_orderdate as varchar) as o_orderdate, o_orderpriority
        from orders""",
    "vault_sat_incremental": f"""
        with n as (select *, case when o_orderdate >= timestamp '2000-01-01' then 'F' else o_orderstatus end as st from orders)
        select md5(cast(o_orderkey as varchar)) as ORDER_HK, '{DAY_2}' as LOAD_DATE, 'OMS.ORDERS' as RECORD_SOURCE,
               {_DIFF.format(status='st')} as ORDER_HASHDIFF, st as o_orderstatus, o_totalprice,
               cast(o_orderdate as varchar) as o_orderdate, o_orderpriority
        from n where {_DIFF.format(status='st')} <> {_DIFF.format(status='o_orderstatus')}""",
    "vault_sat_history": f"""
        with {_SAT_EVENT}
        select USER_HK, cast(LOAD_DATE as varchar) as LOAD_DATE, RECORD_SOURCE, EVENT_HASHDIFF, event_type from sat""",
    "vault_sat_end_dated": f"""
        with {_SAT_EVENT}
        select USER_HK, cast(LOAD_DATE as varchar) as LOAD_DATE, RECORD_SOURCE, EVENT_HASHDIFF, event_type,
               coalesce(cast(lead(LOAD_DATE) over (partition by USER_HK order by LOAD_DATE) as varchar),
                        '8888-12-31 23:59:59') as LOAD_END_DATE
        from sat""",
    "vault_pit": f"""
        with {_SAT_EVENT},
        snap as (select unnest([{', '.join(f"timestamp '{s}'" for s in SNAPSHOTS)}]) as d),
        hub as (select distinct md5(cast(user_id as varchar)) as USER_HK from events)
        select hub.USER_HK, cast(d as varchar) as SNAPSHOT_DATE,
               coalesce(cast((select max(LOAD_DATE) from sat where sat.USER_HK = hub.USER_HK and LOAD_DATE <= d) as varchar),
                        '1970-01-01 00:00:00') as SAT_EVENT_LDTS
        from hub, snap""",
    "vault_ghost": f"""
        select md5(cast(c_custkey as varchar)) as CUSTOMER_HK, '{DAY_1}' as LOAD_DATE, 'CRM.CUSTOMER' as RECORD_SOURCE,
               md5(coalesce(c_name,'') || '||' || coalesce(cast(c_nationkey as varchar),'') || '||' ||
                   coalesce(cast(cast(c_acctbal as decimal(18,2)) as varchar),'') || '||' || coalesce(c_mktsegment,'')) as CUSTOMER_HASHDIFF,
               c_mktsegment from customer
        union all
        select repeat('0', 32), '1970-01-01 00:00:00', 'SYSTEM', repeat('0', 32), null""",
    "vault_key_checks": """
        select t as table_name, n as rows_checked, d as duplicate_keys, m as missing_values,
               case when d > 0 or m > 0 then 'FAIL' else 'PASS' end as status
        from (
          select 'HUB_ORDER' as t, count(*) as n, count(*) - count(distinct o_orderkey) as d, count(*) - count(o_orderkey) as m from orders
          union all select 'LNK_CUSTOMER_ORDER', count(*), count(*) - count(distinct (o_custkey, o_orderkey)), 0 from orders
          union all select 'HUB_LINE', count(*), count(*) - count(distinct (l_orderkey, l_linenumber)), 0 from lineitem
          union all select 'SAT_ORDER', count(*), 0, 0 from orders)""",
    "vault_sha256_key": """
        select c_custkey, sha256(cast(c_custkey as varchar) || '||' || c_mktsegment) as hk_sha256,
               upper(left(upper(sha256(upper(trim(c_name)) || '|' || upper(trim(c_mktsegment)))), 32)) as hk_normalised
        from customer""",
    "vault_order_360": """
        select c_mktsegment, count(distinct c_custkey) as customers, count(*) as orders,
               cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total_value
        from customer join orders on c_custkey = o_custkey
        where o_orderstatus in ('F', 'O') and o_totalprice > 0 group by c_mktsegment""",
}
