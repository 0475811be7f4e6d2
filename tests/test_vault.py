"""Loaders: idempotence, late data, ghosts, point in time, key hashes, streaming equals batch."""

import hashlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from etlvault.operators import vault
from etlvault.streaming import vault_stream as vs


def frame(spark, data):
    df = spark.createDataFrame(data, "id int, name string, city string, at string")
    return vault.stage(df.withColumn("at", F.col("at").cast("timestamp_ntz")), {"HK": ["id"]}, F.col("at"), "SRC",
                       {"HD": ["name", "city"]})


BASE = [(1, "a", "x", "2024-01-01"), (1, "a", "x", "2024-01-03"), (1, "b", "x", "2024-02-05"), (2, "c", None, "2024-01-02"),
        (None, "n", "n", "2024-01-02")]


def sat(staged, stored=None, bucket="DAY"):
    return vault.load_satellite(staged, "HK", "HD", ["name", "city"], stored, bucket)


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def test_hash_key_forms(spark):
    from etlvault.functions.hashing import hash_diff, hash_key, normalised_key
    df = spark.createDataFrame([(1, "b", None), (2, None, "x")], "a int, b string, c string")
    r = df.select(hash_key(["a", "b"]).alias("k"), hash_key(["a"], "sha256").alias("s"), hash_diff(["b", "c"]).alias("d"),
                  normalised_key(["a", "b"]).alias("n")).collect()
    assert r[0].k == md5("1||b") and r[1].k is None
    assert r[0].s == hashlib.sha256(b"1").hexdigest()
    assert r[0].d == md5("b||") and r[1].d == md5("||x")
    assert r[0].n == hashlib.sha256(b"1|B").hexdigest().upper()[:32]
    with pytest.raises(ValueError):
        hash_key(["a"], "crc")


def test_hub_keeps_first_record_and_reload_adds_nothing(spark, rows):
    staged = frame(spark, BASE)
    hub = vault.load_hub(staged, "HK", ["id"])
    assert rows(hub.withColumn("LOAD_DATE", F.col("LOAD_DATE").cast("string")), "id", "LOAD_DATE") == [
        (1, "2024-01-01 00:00:00"), (2, "2024-01-02 00:00:00")]
    assert vault.load_hub(staged, "HK", ["id"], stored=hub).count() == 0


def test_satellite_changes_only_and_reload(spark, rows):
    staged = frame(spark, BASE)
    first = sat(staged)
    assert rows(first, "name") == [("a",), ("b",), ("c",)]
    assert sat(staged, stored=first).count() == 0
    assert rows(sat(staged, bucket=None)) == rows(first)


def test_satellite_late_row_is_placed_among_stored_ones(spark, rows):
    stored = sat(frame(spark, BASE))
    late = frame(spark, [(1, "z", "x", "2024-01-15"), (1, "a", "x", "2024-01-20"), (1, "b", "x", "2024-03-01"), (2, "c", None, "2024-01-09")])
    # z differs from a before it; a differs from z; b equals the stored b; c equals c
    assert rows(sat(late, stored=stored), "name") == [("a",), ("z",)]


def test_satellite_same_key_and_date_counts_once(spark):
    twice = frame(spark, [(1, "a", "x", "2024-01-01"), (1, "b", "x", "2024-01-01")])
    assert sat(twice).count() == 1


def test_link_needs_both_parents(spark):
    df = spark.createDataFrame([(1, 10), (1, 10), (2, None), (2, 11)], "a int, b int")
    staged = vault.stage(df, {"L_HK": ["a", "b"], "A_HK": ["a"], "B_HK": ["b"]}, "2024-01-01", "S")
    link = vault.load_link(staged, "L_HK", ["A_HK", "B_HK"])
    assert link.count() == 2
    assert vault.load_link(staged, "L_HK", ["A_HK", "B_HK"], stored=link, single_batch=True).count() == 0


def test_batch_loads_dedupe_before_hashing(spark, rows):
    df = spark.createDataFrame([(1, "a||b", "c"), (1, "a", "b||c"), (1, "a", "b||c"), (2, None, "x")], "i int, p string, q string")
    # both texts read a||b||c: one hash key, one row
    link = vault.load_link_batch(df, "L_HK", {"P_HK": ["p"], "Q_HK": ["q"]}, "2024-01-01", "S")
    assert link.count() == 1
    hub = vault.load_hub_batch(df, "I_HK", ["i"], "2024-01-01", "S")
    staged = vault.stage(df, {"I_HK": ["i"]}, "2024-01-01", "S")
    assert hub.columns == vault.load_hub(staged, "I_HK", ["i"]).columns
    assert rows(hub) == rows(vault.load_hub(staged, "I_HK", ["i"]))
    assert vault.load_hub_batch(df, "I_HK", ["i"], "2024-01-02", "S", stored=hub).count() == 0


def test_end_dates_and_point_in_time(spark, rows):
    staged = frame(spark, BASE)
    satellite = sat(staged)
    ends = vault.end_dated(satellite, "HK").withColumn("e", F.col("LOAD_END_DATE").cast("string"))
    assert rows(ends, "name", "e") == [("a", "2024-02-05 00:00:00"), ("b", "8888-12-31 23:59:59"), ("c", "8888-12-31 23:59:59")]
    hub = vault.load_hub(staged, "HK", ["id"])
    pit = vault.point_in_time(hub, {"s": satellite}, "HK", ["2024-01-01 12:00:00", "2024-02-05 00:00:00"])
    got = rows(pit.join(hub.select("HK", "id"), "HK").select("id", *[F.col(c).cast("string").alias(c) for c in ("SNAPSHOT_DATE", "s")]))
    assert got == [(1, "2024-01-01 12:00:00", "2024-01-01 00:00:00"), (1, "2024-02-05 00:00:00", "2024-02-05 00:00:00"),
                   (2, "2024-01-01 12:00:00", "1970-01-01 00:00:00"), (2, "2024-02-05 00:00:00", "2024-01-02 00:00:00")]


def test_point_in_time_of_a_year_of_days(spark):
    days = [f"{datetime(2024, 1, 1) + timedelta(days=d)}" for d in range(365)]
    versions = [("k", f"2024-{m:02d}-03 06:00:00") for m in range(1, 13)] + [("k", "2024-05-03 09:00:00"), ("late", "2030-01-01 00:00:00")]
    satellite = spark.createDataFrame(versions, "HK string, d string").select("HK", F.col("d").cast("timestamp_ntz").alias("LOAD_DATE"))
    hub = spark.createDataFrame([("k",), ("late",), ("none",)], "HK string")
    asked = [*reversed(days), days[7]]  # in any order, one of them twice
    pit = vault.point_in_time(hub, {"s": satellite}, "HK", asked)
    got = sorted((r.HK, str(r.SNAPSHOT_DATE), str(r.s)) for r in pit.collect())

    def valid(key, day):
        return max((v for k, v in versions if k == key and v <= day), default="1970-01-01 00:00:00")

    assert got == sorted((k, d, valid(k, d)) for k in ("k", "late", "none") for d in asked)
    plan = pit._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("max(") == 1  # the plan holds one aggregate, however many the snapshots


def test_ghost_is_added_once(spark):
    hub = vault.load_hub(frame(spark, BASE), "HK", ["id"])
    once = vault.with_ghost(hub, ["HK"])
    assert once.count() == hub.count() + 1 == vault.with_ghost(once, ["HK"]).count()
    ghost = once.filter("RECORD_SOURCE = 'SYSTEM'").collect()[0]
    assert ghost.HK == "0" * 32 and ghost.id is None


def test_key_checks_count_duplicates_and_nulls(spark):
    t = spark.createDataFrame([("a", 1), ("a", 1), ("b", None), (None, 2)], "hk string, v int")
    r = vault.key_checks({"T": (t, "hk", ["hk", "v"])}).collect()[0]
    assert (r.rows_checked, r.duplicate_keys, r.missing_values, r.status) == (4, 1, 2, "FAIL")


def test_layers_and_bucketed_tables(spark, tmp_path):
    hub = vault.load_hub(frame(spark, BASE), "HK", ["id"])
    vault.materialise(hub, "staging", "stg_hub")
    assert spark.table("stg_hub").count() == 2
    for _ in range(2):
        vault.materialise(hub, "raw_vault", "hub", str(tmp_path / "raw"))
        vault.materialise(hub, "business_vault", "hub", str(tmp_path / "bv"))
    assert spark.read.parquet(str(tmp_path / "raw")).count() == 4 and spark.read.parquet(str(tmp_path / "bv")).count() == 2
    with pytest.raises(ValueError):
        vault.materialise(hub, "other", "x")
    spark.sql("drop table if exists hub_t")
    spark.sql("drop table if exists sat_t")
    vault.append_table(hub, "hub_t", "HK", 4)
    vault.append_table(sat(frame(spark, BASE)), "sat_t", "HK", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("hub_t").join(spark.table("sat_t"), "HK")
        assert joined.count() == 3
        plan = joined._jdf.queryExecution().sparkPlan().toString() + joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_stream_equals_batch_and_replay_is_harmless(spark, rows, tmp_path):
    source = spark.createDataFrame(
        [(i % 7, ["a", "b", "c"][(i * i) % 3], "DELETE" if i % 11 == 0 else "UPDATE", i) for i in range(300)],
        "id int, name string, op string, s int").withColumn("at", F.timestamp_seconds(F.lit(1.7e9) + F.col("s") * 3600).cast("timestamp_ntz"))
    incoming = tmp_path / "in"
    # four files in arrival order
    for part in range(4):
        source.filter((F.col("s") >= part * 75) & (F.col("s") < part * 75 + 75)).coalesce(1).write.mode("append").parquet(str(incoming))

    def stage(df):
        return vault.stage(df, {"HK": ["id"]}, F.col("at"), "CDC", {"HD": ["name"]})

    loads = [vs.HubLoad("hub", "HK", ("id",)), vs.SatelliteLoad("sat", "HK", "HD", ("name",)), vs.LinkLoad("lnk", "HD", ("HK",))]
    folder = vs.VaultFolder(spark, str(tmp_path / "vault"), loads)
    changes = vs.only_changes(vs.read_changes(spark, str(incoming), source.schema, files_per_batch=1), "op", ["INSERT", "UPDATE"])
    vs.stream_load(changes, stage, folder, str(tmp_path / "ck")).awaitTermination()
    assert folder.read(vs.LOG).select("batch_id").distinct().count() > 1

    whole = stage(source.filter("op = 'UPDATE'"))
    batch_sat = vault.load_satellite(whole, "HK", "HD", ["name"])
    assert rows(folder.read("hub"), "HK", "id") == rows(vault.load_hub(whole, "HK", ["id"]), "HK", "id")
    # a version may be stored twice in a row only where an older batch arrived later; chains read the same
    ours = vault.load_satellite(folder.read("sat"), "HK", "HD", ["name"])
    assert rows(ours, "HK", "LOAD_DATE", "name") == rows(batch_sat, "HK", "LOAD_DATE", "name")
    before = folder.read("sat").count(), folder.read("hub").count()
    folder.load(whole, 99)
    assert (folder.read("hub").count()) == before[1]
    again = vault.load_satellite(folder.read("sat"), "HK", "HD", ["name"])
    assert rows(again, "HK", "LOAD_DATE") == rows(batch_sat, "HK", "LOAD_DATE")


def test_a_batch_reads_only_the_partitions_of_its_keys(spark, rows, tmp_path):
    def stage(ids, when):
        df = spark.createDataFrame([(i, f"n{i}") for i in ids], "id int, name string")
        return vault.stage(df, {"HK": ["id"]}, when, "CDC", {"HD": ["name"]})

    folder = vs.VaultFolder(spark, str(tmp_path / "v"), [vs.HubLoad("hub", "HK", ("id",)), vs.SatelliteLoad("sat", "HK", "HD", ("name",))], key_digits=2)
    folder.load(stage(range(300), "2024-01-01"), 0)
    batch = stage([3, 7, 1000], "2024-01-02")
    touched = folder.touched(batch, ["HK"])["HK"]
    assert touched == sorted(r[0][:2] for r in batch.select("HK").collect())
    stored = folder.stored("sat", folder.loads[1].rows(batch, None), touched)
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "key_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    read = {f.split("key_bucket=")[1][:2] for r in stored.select(F.input_file_name()).distinct().collect() for f in r}
    assert read and read <= set(touched)
    assert stored.columns == ["HK", "LOAD_DATE", "RECORD_SOURCE", "HD", "name"]
    folder.load(batch, 1)
    assert rows(folder.read("hub"), "id") == rows(spark.createDataFrame([(i,) for i in [*range(300), 1000]], "id int"))
    assert folder.read("sat").count() == 301
    folder.load(stage([], "2024-01-03"), 2)
    assert folder.read("hub").count() == 301


def test_satellite_of_few_dates_moves_rows_once_and_equals_the_window(spark, rows):
    """Repeated, late, stored and equal versions over three dates, on the way by date and on the plain window."""
    days = ["2024-01-01", "2024-01-02", "2024-01-03"]
    data = [(k, v, None if (k + i) % 5 == 0 else "c", days[i]) for k in range(60) for i in range(3) for v in ("ab"[(k >> i) & 1], "cd"[k & 1])[:1 + (k % 4 == 0)]
            if (k * 7 + i) % 6]
    staged = frame(spark, [*data, (None, "n", "n", days[0])])
    stored = vault.load_satellite(staged.filter("day(LOAD_DATE) = 2 AND id % 3 > 0"), "HK", "HD", ["name", "city"])
    for known in (None, stored):
        ours = vault.load_satellite(staged, "HK", "HD", ["name", "city"], known)
        assert rows(ours) == rows(sat(staged, known, bucket=None)) and ours.columns == sat(staged, known, bucket=None).columns
        plan = ours._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan
    many = frame(spark, [(1, str(i), None, f"2024-01-{i:02d}") for i in range(1, 9)])
    assert "Window" in vault.load_satellite(many, "HK", "HD", ["name"])._jdf.queryExecution().optimizedPlan().toString()
    lost = frame(spark, [(1, "a", None, None), (1, "b", None, days[0])])
    assert vault.load_satellite(lost, "HK", "HD", ["name"]).count() == 2
