"""The events table arriving as a stream of changes, loaded into a hub and a satellite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from etlvault.operators import vault
from etlvault.session import scratch_path
from etlvault.streaming import vault_stream as vs
from etlvault.workload.tables import table

CHANGES = ("signup", "click", "purchase")
LOADS = (vs.HubLoad("hub_user", "USER_HK", ("user_id",)), vs.SatelliteLoad("sat_event", "USER_HK", "EVENT_HASHDIFF", ("event_type",)))


def stage(batch: DataFrame) -> DataFrame:
    return vault.stage(batch, {"USER_HK": ["user_id"]}, F.col("ts"), "WEB.EVENTS", {"EVENT_HASHDIFF": ["event_type"]})


def load_events(spark, sf_dir) -> vs.VaultFolder:
    schema = table(spark, sf_dir, "events").schema
    changes = vs.only_changes(vs.read_changes(spark, sf_dir, schema, "events.parquet"), "event_type", CHANGES)
    folder = vs.VaultFolder(spark, scratch_path(spark, "vault"), LOADS)
    vs.stream_load(changes, stage, folder, scratch_path(spark, "offsets")).awaitTermination()
    return folder


def stream_satellite(spark, sf_dir):
    return load_events(spark, sf_dir).read("sat_event").withColumn("LOAD_DATE", F.col("LOAD_DATE").cast("string"))


def stream_hub(spark, sf_dir):
    return load_events(spark, sf_dir).read("hub_user").withColumn("LOAD_DATE", F.col("LOAD_DATE").cast("string"))


QUERIES = {"stream_vault_satellite": stream_satellite, "stream_vault_hub": stream_hub}

_KINDS = ", ".join(f"'{c}'" for c in CHANGES)
ORACLE = {
    "stream_vault_satellite": f"""
        select USER_HK, cast(ts as varchar) as LOAD_DATE, 'WEB.EVENTS' as RECORD_SOURCE, d as EVENT_HASHDIFF, event_type from (
          select *, lag(d) over (partition by USER_HK order by ts) as before from (
            select md5(cast(user_id as varchar)) as USER_HK, ts, md5(event_type) as d, event_type,
                   row_number() over (partition by user_id, ts order by md5(event_type)) as rn
            from events where event_type in ({_KINDS})) where rn = 1)
        where before is null or before <> d""",
    "stream_vault_hub": f"""
        select md5(cast(user_id as varchar)) as USER_HK, user_id, cast(min(ts) as varchar) as LOAD_DATE, 'WEB.EVENTS' as RECORD_SOURCE
        from events where event_type in ({_KINDS}) group by user_id""",
}
