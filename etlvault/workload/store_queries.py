"""Tables, histories, reports and metadata that are written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from etlvault.functions import masking
from etlvault.operators import profile, vault
from etlvault.session import scratch_path
from etlvault.sources import history, tables
from etlvault.workload import derived
from etlvault.workload.tables import table, wide

RUNS = ("2024-01-02 00:00:00", "2024-01-03 00:00:00")
COMMON = {"column_name": "name", "data_type": "type"}


def csv_customer(spark, sf_dir):
    """The customers as delimited text, read under a schema."""
    customer = table(spark, sf_dir, "customer")
    path = scratch_path(spark, "customer") + ".csv"
    customer.write.option("header", True).csv(path)
    return tables.read_table(spark, path, schema=", ".join(f"{n} {t}" for n, t in customer.dtypes))


def history_latest(spark, sf_dir):
    """Overviews of two data sets, one of them profiled twice; the rows of each one's last run."""
    target = scratch_path(spark, "history")
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    for name, frame, run in (("customer", customer, RUNS[0]), ("orders", orders, RUNS[0]), ("customer", customer.filter("c_acctbal > 0"), RUNS[1])):
        history.append_history(profile.overview(frame, name, run), target)
    return history.latest_run(history.read_history(spark, target)).select("dataset_name", "run_timestamp", "n_rows", "n_missing_cells")


def history_key(spark, sf_dir):
    """The key id of a data set's last run, from one registry row per customer segment and run."""
    segments = table(spark, sf_dir, "customer").select("c_mktsegment").distinct()
    registry = segments.select(F.col("c_mktsegment").alias("dataset_name"), F.explode(F.array(*map(F.lit, RUNS))).alias("run_timestamp"))
    registry = registry.withColumn("key_id", F.md5(F.concat("dataset_name", "run_timestamp")))
    return history.latest_key(registry, "BUILDING")


def report_parts(spark, sf_dir):
    """A report's parts as written, read back: rows and values of each."""
    path = scratch_path(spark, "report")
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    parts = history.report_tables(events.groupBy("event_type").agg(F.count("*").alias("value")), events, {"errors": events.filter("event_type = 'error'")})
    history.write_report(parts, path)
    out = None
    for name, frame in parts.items():
        kept = tables.read_table(spark, f"{path}/{name}", "json", ", ".join(f"{n} {t}" for n, t in frame.dtypes))
        part = kept.agg(F.lit(name).alias("part"), F.count("*").alias("n"), F.count("event_type").alias("typed"), F.round(F.sum("value"), 2).cast("double").alias("total"))
        out = part if out is None else out.unionByName(part)
    return out


def metadata_renamed(spark, sf_dir):
    """The catalog written in one dialect of column names, read back and brought to the common one."""
    path = scratch_path(spark, "metadata")
    catalog = derived.catalog(spark, sf_dir).select("tool", "table_name", *[F.col(c).alias(n) for c, n in COMMON.items()])
    history.write_metadata({"columns": catalog}, path)
    kept = history.read_metadata(spark, path, {"columns": "tool string, table_name string, name string, type string"})["columns"]
    return history.to_common(kept, "column").select("tool", "table_name", *COMMON)


def mask_ssn(spark, sf_dir):
    """Order keys as social security numbers, and as they are."""
    digits = F.lpad(F.col("o_orderkey").cast("string"), 9, "0")
    number = F.concat_ws("-", F.substring(digits, 1, 3), F.substring(digits, 4, 2), F.substring(digits, 6, 4))
    return table(spark, sf_dir, "orders").select("o_orderkey", masking.mask_ssn(number).alias("masked"), masking.mask_ssn(F.col("o_orderkey").cast("string")).alias("plain"))


def vault_layers(spark, sf_dir):
    """Customers through the layers: a view, two appends of which the second finds nothing new, a new table."""
    staged = vault.stage(wide(spark, sf_dir, "customer", "c_custkey", "c_mktsegment"), {"CUSTOMER_HK": ["c_custkey"]}, RUNS[0], "CRM.CUSTOMER")
    raw, business = scratch_path(spark, "raw"), scratch_path(spark, "business")
    vault.materialise(staged, "staging", "stg_customer")
    vault.materialise(vault.load_hub(spark.table("stg_customer"), "CUSTOMER_HK", ["c_custkey"]), "raw_vault", "hub_customer", raw)
    stored = spark.read.parquet(raw)
    vault.materialise(vault.load_hub(spark.table("stg_customer"), "CUSTOMER_HK", ["c_custkey"], stored), "raw_vault", "hub_customer", raw)
    segments = spark.read.parquet(raw).join(spark.table("stg_customer").select("CUSTOMER_HK", "c_mktsegment"), "CUSTOMER_HK")
    vault.materialise(segments.groupBy("c_mktsegment").agg(F.count("*").alias("customers"), F.min("CUSTOMER_HK").alias("least_key")), "business_vault", "segments", business)
    return spark.read.parquet(business)


QUERIES = {"source_csv": csv_customer, "history_latest": history_latest, "history_key": history_key, "report_parts": report_parts,
           "metadata_renamed": metadata_renamed, "mask_ssn": mask_ssn, "vault_layers": vault_layers}

ORACLE = {
    "source_csv": "select * from customer",
    "history_latest": f"""
        select 'customer' as dataset_name, '{RUNS[1]}' as run_timestamp, count(*) as n_rows, cast(0 as bigint) as n_missing_cells from customer where c_acctbal > 0
        union all select 'orders', '{RUNS[0]}', count(*), 0 from orders""",
    "history_key": f"select max(md5(c_mktsegment || '{RUNS[1]}')) as key_id from customer where c_mktsegment = 'BUILDING'",
    "report_parts": """
        select 'summary' as part, count(*) as n, count(event_type) as typed, round(cast(sum(n) as double), 2) as total from (select event_type, count(*) as n from events group by 1)
        union all select 'all', count(*), count(event_type), round(sum(value), 2) from events
        union all select 'errors', count(*), count(event_type), round(sum(value), 2) from events where event_type = 'error'""",
    "metadata_renamed": f"with {derived.CATALOG_SQL} select tool, table_name, column_name, data_type from cat "
                        "union all select 'mapping_export', 'TGT_S' || lpad(cast(s_suppkey as varchar), 9, '0'), 'S_NAME', 'VARCHAR(25)' from supplier",
    "mask_ssn": """
        select o_orderkey, '***-**-' || right(lpad(cast(o_orderkey as varchar), 9, '0'), 4) as masked,
               case when length(cast(o_orderkey as varchar)) >= 4 then '***-**-' || right(cast(o_orderkey as varchar), 4) else '***-**-****' end as plain from orders""",
    "vault_layers": "select c_mktsegment, count(*) as customers, min(md5(cast(c_custkey as varchar))) as least_key from customer group by 1",
}
