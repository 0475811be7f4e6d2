"""Order-dependent helpers that never gather one key, or one table, in a single task."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from etlvault.functions.columns import col, cols
from etlvault.session import cut_lineage

EQUAL_RUNS = 0  # as many runs of equal size as the session has shuffle partitions
_BUCKET, _EDGE, _CARRY = "__order_bucket", "__time_edge", "__time_carry"
_PART, _POS, _BASE = "__range_part", "__range_pos", "__range_base"


def order_cuts(df: DataFrame, order: str, buckets: int = EQUAL_RUNS) -> list[str]:
    """Values of ``order``, as text, that part all rows of ``df`` into about equal runs.

    One aggregate over that column alone; its summaries are of bounded size and at most
    ``buckets - 1`` values come back. Repeated values give one cut.
    """
    return df.agg(_cuts(df, order, buckets).alias("c")).head()["c"] or []


def _cuts(df: DataFrame, order: str, buckets: int) -> Column:
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if buckets < 2:
        return F.lit(None)
    shares = [i / buckets for i in range(1, buckets)]
    found = F.array_sort(F.array_distinct(F.percentile_approx(col(order), shares, 10 * buckets)))
    return F.transform(found, lambda v: v.cast("string"))


def few_or_cuts(df: DataFrame, order: str, most: int, buckets: int = EQUAL_RUNS) -> tuple[list[str], list[str]]:
    """All values of ``order``, as text and in order, if there are at most ``most`` and none is NULL, or else no values but the cuts.

    The aggregate that finds the cuts also estimates the number of values; the values are made distinct only if it is small.
    """
    count = F.approx_count_distinct(col(order)).alias("n")
    found = df.agg(count, _cuts(df, order, buckets).alias("c")).head()
    if found["n"] <= 2 * most:
        values = [r[0] for r in df.select(col(order).cast("string")).distinct().limit(most + 1).collect()]
        if len(values) <= most and None not in values:
            return sorted(values), []
    return [], found["c"] or []


def leading(size: int, holds: Callable[[Column], Column]) -> Column:
    """How many of at most ``size`` places, from 0, pass a test that holds up to some place and not after it, by halving.

    The test must not hold for places past the end.
    """
    steps = [1 << k for k in reversed(range(size.bit_length()))]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0),
                       lambda place, step: F.when(holds(place + step - 1), place + step).otherwise(place))


def order_bucket(value: Column, cuts: Sequence[str], kind: str) -> Column:
    """Number of cuts at or below ``value``, by halving."""
    if not cuts:
        return F.lit(0)
    at = F.array(*map(F.lit, cuts)).cast(f"array<{kind}>")
    return leading(len(cuts), lambda place: F.get(at, place) <= value)


def with_neighbour(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str, following: bool = False,
                   bucket: str | int | None = EQUAL_RUNS, sample: DataFrame | None = None, cuts: Sequence[str] | None = None) -> DataFrame:
    """Add ``name``: the ``value`` of the previous (or following) row of the same key.

    A hot key would put all its rows into one window task, so the window runs per key and
    bucket of ``order``. A number of buckets, by default that of the shuffle partitions, cuts
    all rows into runs of equal size, so that a key holds no more than one run's rows, a fair
    share, in a bucket, however dense it is in time; the cuts are taken from ``sample``, a cheaper frame with the same column, where given, or handed over as ``cuts``.
    The name of a time unit takes calendar buckets instead. The last (first) row of each
    bucket is carried to the next (previous) bucket of the key, which leaves one row per key
    and bucket to order. ``order`` must be unique per key and ``value`` not NULL.
    ``bucket=None`` asks for the plain window, for data known to hold few rows per key.
    """
    shift = F.lead if following else F.lag
    if bucket is None:
        return df.withColumn(name, shift(col(value)).over(
            Window.partitionBy(*cols(keys)).orderBy(col(order))))

    if isinstance(bucket, int):
        if cuts is None:
            cuts = order_cuts(df if sample is None else sample, order, bucket)
        spot = order_bucket(col(order), cuts, dict(df.dtypes)[order])
    else:
        spot = F.date_trunc(bucket, col(order))
    in_bucket = Window.partitionBy(*cols(keys), F.col(_BUCKET)).orderBy(col(order))
    counter = F.lag if following else F.lead
    local = (
        df.withColumn(_BUCKET, spot)
        .withColumn(name, shift(col(value)).over(in_bucket))
        # a row without a local neighbour on the other side closes its bucket
        .withColumn(_EDGE, counter(col(order)).over(in_bucket).isNull())
    )
    across = Window.partitionBy(*cols(keys)).orderBy(F.col(_BUCKET))
    edges = (
        local.filter(F.col(_EDGE))
        .select(*cols(keys), _BUCKET, shift(col(value)).over(across).alias(_CARRY))
        .filter(F.col(_CARRY).isNotNull())  # only keys that span buckets
    )
    return (
        local.join(edges, [*keys, _BUCKET], "left")
        .withColumn(name, F.coalesce(col(name), F.col(_CARRY)))
        .select(*cols(df.columns), col(name))
    )


def _add_offsets(placed: DataFrame, name: str, columns: Sequence[str]) -> DataFrame:
    """Add to each row's running value the totals of the partitions before its own."""
    totals = placed.groupBy(_PART).agg(F.max(_POS).alias(_BASE))
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(_PART, F.coalesce(F.sum(_BASE).over(before), F.lit(0)).alias(_BASE))
    # one row per partition: bounded by the partition count, so it may be broadcast
    return (placed.join(F.broadcast(offsets), _PART)
            .withColumn(name, F.col(_POS) + F.col(_BASE)).select(*cols(columns), col(name)))


def with_running_sum(df: DataFrame, order: Sequence[str], amount: Column, name: str) -> DataFrame:
    """Add ``name``: the running sum of a non-negative ``amount`` over the whole frame in a total order.

    The frame is range-partitioned, each partition keeps its own running sum and the
    sums of the partitions before it are added; only one row per partition is gathered.
    """
    ranged = cut_lineage(df.withColumn(_POS, amount).repartitionByRange(*cols(order)).withColumn(_PART, F.spark_partition_id()))
    local = Window.partitionBy(_PART).orderBy(*cols(order)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return _add_offsets(ranged.withColumn(_POS, F.sum(_POS).over(local)), name, df.columns)


def with_running_number(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Add ``name``: 1, 2, 3 … over the whole frame in a total order.

    Inside a sorted partition the generated row id already counts from zero, so numbering
    takes one range shuffle and no window.
    """
    row_in_partition = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = cut_lineage(
        df.repartitionByRange(*cols(order)).sortWithinPartitions(*cols(order))
        .withColumn(_PART, F.spark_partition_id()).withColumn(_POS, row_in_partition + 1))
    return _add_offsets(ranged, name, df.columns)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each key. Partial aggregation keeps a hot key small before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    lead = list(order) + [c for c in rest if c not in order]
    picked = df.groupBy(*cols(keys)).agg(F.min(F.struct(*cols(lead))).alias("__first"))
    values = {c: F.col("__first").getField(c) for c in lead}
    return picked.select(*[col(c) if c in keys else values[c].alias(c) for c in df.columns])
