"""Data Vault loads: staging, hubs, links, satellites, point-in-time and ghost records.

Every loader returns the rows to append. A second load of the same batch returns none,
so a job that lost executors, or a replayed micro-batch, can simply run again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from etlvault.functions.columns import col, cols
from etlvault.functions.hashing import hash_diff, hash_key
from etlvault.operators.ordered import EQUAL_RUNS, few_or_cuts, first_by, leading, with_neighbour

LOAD_DATE, RECORD_SOURCE, END_DATE = "LOAD_DATE", "RECORD_SOURCE", "LOAD_END_DATE"

# Fixed values of the vault convention.
BEGIN_OF_TIME = "1970-01-01 00:00:00"
END_OF_TIME = "8888-12-31 23:59:59"
GHOST_SOURCE = "SYSTEM"
HASH_WIDTH = {"md5": 32, "sha256": 64}
# Load dates up to which a satellite load keeps the versions of a key in one row, a column per date.
FEW_DATES = 4


def technical_columns(df: DataFrame, load_date: Column | str, record_source: str) -> DataFrame:
    """Add LOAD_DATE and RECORD_SOURCE. The load date is an argument, so reruns agree."""
    when = F.lit(load_date).cast("timestamp_ntz") if isinstance(load_date, str) else load_date
    return df.withColumn(LOAD_DATE, when).withColumn(RECORD_SOURCE, F.lit(record_source))


def stage(df: DataFrame, hash_keys: Mapping[str, Sequence[str]], load_date: Column | str,
          record_source: str, hash_diffs: Mapping[str, Sequence[str]] | None = None,
          algorithm: str = "md5", scales: Mapping[str, int] | None = None) -> DataFrame:
    """One projection with all hash keys, hash differences and technical columns a load needs."""
    keys = [hash_key(parts, algorithm, scales).alias(n) for n, parts in hash_keys.items()]
    diffs = [hash_diff(parts, algorithm, scales).alias(n) for n, parts in (hash_diffs or {}).items()]
    return technical_columns(df.select("*", *keys, *diffs), load_date, record_source)


def _not_stored(rows: DataFrame, stored: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    if stored is None:
        return rows
    return rows.join(stored.select(*cols(keys)), list(keys), "left_anti")


def load_hub(staged: DataFrame, hub_key: str, business_keys: Sequence[str],
             stored: DataFrame | None = None, single_batch: bool = False) -> DataFrame:
    """New hub rows: the first record of every hash key not stored yet.

    ``single_batch`` states that LOAD_DATE and RECORD_SOURCE are the same on all rows and
    that a hash key stands for one business key, which turns the first-record rule into a
    plain hash-aggregated distinct.
    """
    names = [hub_key, *business_keys, LOAD_DATE, RECORD_SOURCE]
    rows = staged.filter(col(hub_key).isNotNull()).select(*cols(names))
    if single_batch:
        rows = rows.distinct()
    else:
        rows = first_by(rows, [hub_key], [LOAD_DATE, RECORD_SOURCE, *business_keys])
    return _not_stored(rows, stored, [hub_key])


def load_link(staged: DataFrame, link_key: str, hub_keys: Sequence[str],
              stored: DataFrame | None = None, single_batch: bool = False) -> DataFrame:
    """New link rows, insert-only; a row with any missing parent key is not a relation."""
    present = [col(k).isNotNull() for k in (link_key, *hub_keys)]
    rows = staged
    for test in present:
        rows = rows.filter(test)
    return load_hub(rows, link_key, hub_keys, stored, single_batch)


def _one_text(df: DataFrame, columns: Sequence[str]) -> bool:
    """Whether different values of the columns always give different key texts.

    A single column does; several do unless a string may itself hold the separator.
    """
    fixed = (T.IntegralType, T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)
    return len(columns) == 1 or all(isinstance(df.schema[c].dataType, fixed) for c in columns)


def load_link_batch(source: DataFrame, link_key: str, hub_keys: Mapping[str, Sequence[str]], load_date: str, record_source: str,
                    stored: DataFrame | None = None, algorithm: str = "md5", keep: Sequence[str] = ()) -> DataFrame:
    """Link rows of one batch straight from its source rows.

    The business keys are made distinct before they are hashed, so the shuffle carries
    narrow keys and every distinct relation is hashed once. ``keep`` names business key
    columns to carry along. Where the key text could be ambiguous the hashes are made
    distinct as well.
    """
    parts = list(dict.fromkeys(c for columns in hub_keys.values() for c in columns))
    rows = source.select(*cols(parts)).dropna().distinct()
    staged = stage(rows, {link_key: parts, **hub_keys}, load_date, record_source, algorithm=algorithm)
    if not _one_text(source, parts):
        return load_link(staged, link_key, [*hub_keys, *keep], stored)
    names = [link_key, *[k for k in hub_keys if k != link_key], *keep, LOAD_DATE, RECORD_SOURCE]
    return _not_stored(staged.select(*cols(names)), stored, [link_key])


def load_hub_batch(source: DataFrame, hub_key: str, business_keys: Sequence[str], load_date: str, record_source: str,
                   stored: DataFrame | None = None, algorithm: str = "md5") -> DataFrame:
    """Hub rows of one batch straight from its source rows, distinct before hashing."""
    return load_link_batch(source, hub_key, {hub_key: business_keys}, load_date, record_source, stored, algorithm, keep=business_keys)


def load_satellite(staged: DataFrame, hub_key: str, diff: str, payload: Sequence[str],
                   stored: DataFrame | None = None, bucket: str | int | None = EQUAL_RUNS, dates: DataFrame | None = None) -> DataFrame:
    """New satellite rows: those whose hash difference changes against the row before them.

    The row before may be in the batch or in the stored satellite, and older load dates
    arriving late are placed among the stored rows. Rows with the key and load date of a
    stored row are already loaded. Of several batch rows with one key and load date the
    one with the smallest record source and hash difference counts. ``dates`` may name a frame
    that has the load dates of batch and stored rows, all of them, and is cheaper to read.
    """
    identity = [hub_key, LOAD_DATE]
    names = [*identity, RECORD_SOURCE, diff, *payload]
    rows = staged.filter(col(hub_key).isNotNull()).select(*cols(names), F.lit(1).alias("__new"))
    if dates is None:
        dates = staged.select(LOAD_DATE) if stored is None else staged.select(LOAD_DATE).unionByName(stored.select(LOAD_DATE))
    few, cuts = few_or_cuts(dates, LOAD_DATE, FEW_DATES, bucket) if isinstance(bucket, int) else ([], None)
    if few:
        return _load_by_date(rows.drop("__new"), hub_key, diff, stored, few)
    if stored is not None:
        # only the keys of the batch matter, and of them only key, date and hash difference
        touched = rows.select(col(hub_key)).distinct()
        blank = [F.lit(None).cast(staged.schema[p].dataType).alias(p) for p in payload]
        known = stored.join(touched, [hub_key], "left_semi").select(
            *cols([*identity, RECORD_SOURCE, diff]), *blank, F.lit(0).alias("__new"))
        rows = rows.unionByName(known)
    rows = first_by(rows, identity, ["__new", RECORD_SOURCE, diff])
    rows = with_neighbour(rows, [hub_key], LOAD_DATE, diff, "__before", bucket=bucket, sample=dates, cuts=cuts)
    changed = F.col("__before").isNull() | (F.col("__before") != col(diff))
    return rows.filter((F.col("__new") == 1) & changed).select(*cols(names))


def _load_by_date(rows: DataFrame, hub_key: str, diff: str, stored: DataFrame | None, dates: Sequence[str]) -> DataFrame:
    """The satellite load for rows of few load dates, named in order: the versions of a key are one row.

    A key's row holds the first record of each date, so rows are moved once, by key and after map-side
    partials, and neither sorted by date nor joined back to find the version before. Stored rows give hash differences only.
    """
    when = col(LOAD_DATE)
    days = [F.lit(d).cast(rows.schema[LOAD_DATE].dataType) for d in dates]
    rest = [c for c in rows.columns if c not in (hub_key, LOAD_DATE)]
    lead = [RECORD_SOURCE, diff, *[c for c in rest if c not in (RECORD_SOURCE, diff)]]

    def per_key(df: DataFrame, columns: Sequence[str], mark: str) -> DataFrame:
        return df.groupBy(col(hub_key)).agg(*[
            F.min(F.when(when == day, F.struct(*cols(columns)))).alias(f"__{mark}{i}") for i, day in enumerate(days)])

    found = per_key(rows, lead, "new")
    if stored is not None:
        # only the keys of the batch matter
        touched = rows.select(col(hub_key)).distinct()
        known = stored.select(*cols([hub_key, LOAD_DATE, RECORD_SOURCE, diff])).join(touched, [hub_key], "left_semi")
        found = found.join(per_key(known, [RECORD_SOURCE, diff], "old"), [hub_key], "left")
    made, before = [], []
    for i, day in enumerate(days):
        new, old = F.col(f"__new{i}"), F.col(f"__old{i}") if stored is not None else F.lit(None)
        last = F.coalesce(F.lit(None), *reversed(before))
        changed = new.isNotNull() & old.isNull() & (last.isNull() | (last != new.getField(diff)))
        made.append(F.when(changed, F.struct(day.alias(LOAD_DATE), *[new.getField(c).alias(c) for c in lead])))
        before += [new.getField(diff)] if stored is None else [F.coalesce(old.getField(diff), new.getField(diff))]
    return found.select(col(hub_key), F.inline(F.array_compact(F.array(*made)))).select(*cols(rows.columns))


def end_dated(satellite: DataFrame, hub_key: str, bucket: str | int | None = EQUAL_RUNS, dates: DataFrame | None = None) -> DataFrame:
    """Add LOAD_END_DATE: the load date of the next version, or the end of all times.

    ``dates`` may name a frame whose LOAD_DATE is cheaper to read than a derived satellite's.
    """
    rows = with_neighbour(satellite, [hub_key], LOAD_DATE, LOAD_DATE, END_DATE,
                          following=True, bucket=bucket, sample=dates)
    last = F.lit(END_OF_TIME).cast(satellite.schema[LOAD_DATE].dataType)
    return rows.withColumn(END_DATE, F.coalesce(col(END_DATE), last))


def point_in_time(hub: DataFrame, satellites: Mapping[str, DataFrame], hub_key: str,
                  snapshots: Sequence[str]) -> DataFrame:
    """Per hub key and snapshot, the load date of the satellite version valid then.

    ``satellites`` maps an output column to its satellite. A version first counts at the earliest
    snapshot not before it, and of the versions of one key and snapshot the newest does, which is an
    aggregate with map-side partials. What is left of a key, at most one date per snapshot, is
    searched by halving, so the plan does not grow with the snapshots and the satellite is
    read once and never multiplied by them. Without a version the ghost date stands.
    """
    days = sorted({s: None for s in snapshots}, key=datetime.fromisoformat)
    at = F.array(*map(F.lit, days)).cast("array<timestamp_ntz>")
    wide = hub.select(col(hub_key))
    for i, satellite in enumerate(satellites.values()):
        date = col(LOAD_DATE).cast("timestamp_ntz")
        versions = satellite.select(col(hub_key), date.alias("__date"), leading(len(days), lambda place: F.get(at, place) < F.col("__date")).alias("__day"))
        newest = versions.filter(F.col("__day") < len(days)).groupBy(col(hub_key), "__day").agg(F.max("__date").alias("__date"))
        per_key = newest.groupBy(col(hub_key)).agg(F.array_sort(F.collect_list(F.struct("__day", "__date"))).alias(f"__{i}"))
        wide = wide.join(per_key, [hub_key], "left")
    ghost = F.lit(BEGIN_OF_TIME).cast("timestamp_ntz")

    def valid(i: int, day: Column) -> Column:
        versions = F.col(f"__{i}")
        return F.coalesce(F.get(versions, leading(len(days), lambda place: F.get(versions, place)["__day"] <= day) - 1)["__date"], ghost)

    places = F.array(*[F.lit(days.index(s)) for s in snapshots])
    rows = F.transform(places, lambda day: F.struct(
        F.get(at, day).alias("SNAPSHOT_DATE"), *[valid(i, day).alias(n) for i, n in enumerate(satellites)]))
    return wide.select(col(hub_key), F.inline(rows))


def ghost_record(table: DataFrame, hash_columns: Sequence[str], algorithm: str = "md5") -> DataFrame:
    """The zero-key row of a vault table: begin of time, source SYSTEM, empty payload."""
    values = []
    for field in table.schema.fields:
        if field.name in hash_columns:
            value = F.lit("0" * HASH_WIDTH[algorithm])
        elif field.name == LOAD_DATE:
            value = F.lit(BEGIN_OF_TIME).cast(field.dataType)
        elif field.name == RECORD_SOURCE:
            value = F.lit(GHOST_SOURCE)
        else:
            value = F.lit(None).cast(field.dataType)
        values.append(value.alias(field.name))
    return table.sparkSession.range(1).select(*values)


def with_ghost(table: DataFrame, hash_columns: Sequence[str], algorithm: str = "md5") -> DataFrame:
    """The table with its ghost record, added only when it has none yet."""
    zero = F.lit("0" * HASH_WIDTH[algorithm])
    # a pushed-down count instead of an anti join, whose constant key would loop over the table
    present = table.filter(col(hash_columns[0]) == zero).agg(F.count("*").alias("n")).scalar()
    return table.unionByName(ghost_record(table, hash_columns, algorithm).filter(present == 0))


def key_checks(tables: Mapping[str, tuple[DataFrame, str, Sequence[str]]]) -> DataFrame:
    """Key rules of loaded tables: rows, duplicate keys and NULLs in the required columns.

    ``tables`` maps a table name to (frame, unique column or "", not-null columns).
    """
    out: DataFrame | None = None
    for name, (frame, unique, required) in tables.items():
        missing = [F.sum(F.col("__n") * col(c).isNull().cast("bigint")) for c in required]
        total = missing[0]
        for m in missing[1:]:
            total = total + m
        groups = [unique] if unique else []
        # grouped by the checked columns: a repeated key shrinks before the shuffle
        grouped = frame.groupBy(*cols(dict.fromkeys([*groups, *required]))).agg(F.count("*").alias("__n"))
        duplicates = F.lit(0).cast("bigint")
        if unique:
            duplicates = F.sum("__n") - F.count_distinct(col(unique)) - F.sum(
                F.when(col(unique).isNull(), F.col("__n")).otherwise(0))
        row = grouped.agg(
            F.lit(name).alias("table_name"),
            F.coalesce(F.sum("__n"), F.lit(0)).alias("rows_checked"),
            F.coalesce(duplicates, F.lit(0)).alias("duplicate_keys"),
            F.coalesce(total, F.lit(0)).alias("missing_values"),
        )
        out = row if out is None else out.unionByName(row)
    failed = (F.col("duplicate_keys") > 0) | (F.col("missing_values") > 0)
    return out.withColumn("status", F.when(failed, "FAIL").otherwise("PASS"))


def append_table(df: DataFrame, table: str, hub_key: str, buckets: int) -> None:
    """Append to a catalog table bucketed by its hash key.

    With the same bucket count on hub, link and satellite, the anti joins of the next
    load and the joins back read them without shuffling the stored side.
    """
    (df.write.mode("append").format("parquet").bucketBy(buckets, hub_key).sortBy(hub_key)
       .saveAsTable(table))


def materialise(df: DataFrame, layer: str, name: str, path: str | None = None) -> None:
    """Write by layer: staging as a view, raw vault as an append, business vault as a new table."""
    if layer == "staging":
        df.createOrReplaceTempView(name)
    elif layer == "raw_vault":
        df.write.mode("append").parquet(path)
    elif layer == "business_vault":
        df.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"unknown layer: {layer}")
