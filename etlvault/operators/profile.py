"""Column profiling: overview, column statistics, moments, exact quantiles, correlations, histograms."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from etlvault.functions.columns import col, cols, numeric_columns, ratio_pct

QUARTILES = (0.25, 0.5, 0.75)
RELATIVE_ZERO = 1e-12
OCTAVE_STEPS = 1 << 12       # ranges of values by which a natural logarithm grows by one
RANGE_STEPS = 1 << 20        # parts of equal width of one such range
_ABOVE_ZERO, _INFINITE, _NOT_A_NUMBER = 1 << 22, 1 << 24, 1 << 25


def column_type(kind: T.DataType) -> str:
    """Profile type label of a column."""
    if isinstance(kind, T.BooleanType):
        return "Boolean"
    if isinstance(kind, T.NumericType):
        return "Numeric"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "DateTime"
    return "Categorical" if isinstance(kind, T.StringType) else "Unsupported"


def _run(df: DataFrame, dataset: str, run_ts: str) -> DataFrame:
    """Lead with the two columns every history table is keyed by."""
    return df.select(F.lit(dataset).alias("dataset_name"), F.lit(run_ts).alias("run_timestamp"), "*")


def _by_column(df: DataFrame, values: Sequence[Column]) -> DataFrame:
    """(c, v): the values of each row as rows of their own, ``c`` being the place in ``values`` as text."""
    return df.select(*[v.alias(str(i)) for i, v in enumerate(values)]).unpivot([], [str(i) for i in range(len(values))], "c", "v")


def overview(df: DataFrame, dataset: str, run_ts: str) -> DataFrame:
    """Rows, columns, missing cells, duplicate rows and column kinds, from one aggregate.

    ``n_duplicate_rows`` counts the surplus copies, ``n_duplicate_groups`` the distinct
    rows occurring more than once. Rows are told apart by 128 bits of hashes over their
    cells and NULL marks, so the shuffle carries 24 bytes a row however wide the table is.
    """
    labels = [column_type(f.dataType) for f in df.schema.fields]
    missing: Column = F.lit(0)
    for c in df.columns:
        missing = missing + col(c).isNull().cast("int")
    marks = F.concat(*[F.when(col(c).isNull(), "1").otherwise("0") for c in df.columns])
    halves = [F.xxhash64(F.lit(salt), marks, *cols(df.columns)).alias(f"__h{salt}") for salt in (1, 2)]
    rows = df.select(*halves, missing.alias("__m")).groupBy("__h1", "__h2").agg(F.count("*").alias("__n"), F.max("__m").alias("__m"))
    n, cells = F.coalesce(F.sum("__n"), F.lit(0)), F.coalesce(F.sum(F.col("__n") * F.col("__m")), F.lit(0))
    surplus = F.coalesce(F.sum(F.col("__n") - 1), F.lit(0))
    totals = rows.agg(n.alias("n_rows"), cells.alias("n_missing_cells"), surplus.alias("n_duplicate_rows"),
                      F.count_if(F.col("__n") > 1).alias("n_duplicate_groups"))
    width = len(df.columns)
    return _run(totals.select(
        "n_rows", F.lit(width).alias("n_cols"), "n_missing_cells",
        ratio_pct(F.col("n_missing_cells"), F.col("n_rows") * F.lit(width), 4).alias("pct_missing_cells"),
        "n_duplicate_rows", ratio_pct(F.col("n_duplicate_rows"), F.col("n_rows"), 4).alias("pct_duplicate_rows"),
        "n_duplicate_groups", F.lit(labels.count("Numeric")).alias("n_numeric_cols"),
        F.lit(labels.count("Categorical")).alias("n_categorical_cols")), dataset, run_ts)


def null_counts(df: DataFrame) -> DataFrame:
    """Missing values per column in one scan."""
    counts = [F.struct(F.lit(c).alias("column_name"), F.count_if(col(c).isNull()).alias("n_missing")) for c in df.columns]
    return df.agg(F.array(*counts).alias("m")).select(F.inline("m"))


def column_stats(df: DataFrame, dataset: str, run_ts: str, approximate: bool = False) -> DataFrame:
    """Type, missing, distinct and once-only values of every column.

    All columns are counted in one scan and one shuffle: a row is turned into one row per
    column, of the column's number and 128 bits of hashes of the value, so that a frequent value is one
    row per task before the shuffle and a wide text costs no more than a number. The hashes of
    numbers, dates and truth values differ whenever the values do. ``approximate``
    trades the exact counts for distinct-count sketches, without ``n_unique``.
    """
    def shape(frame: DataFrame) -> DataFrame:
        rows = F.col("n_rows")
        return _run(frame.select(
            "column_name", "column_type", "n_missing", ratio_pct(F.col("n_missing"), rows, 4).alias("pct_missing"),
            "n_unique", ratio_pct(F.coalesce("n_unique", "n_distinct"), rows, 4).alias("pct_unique"), "n_distinct"),
            dataset, run_ts)

    if approximate:
        entries = [F.struct(F.lit(f.name).alias("column_name"), F.lit(column_type(f.dataType)).alias("column_type"),
                            F.count_if(col(f.name).isNull()).alias("n_missing"),
                            F.approx_count_distinct(col(f.name)).alias("n_distinct")) for f in df.schema.fields]
        return shape(df.agg(F.count("*").alias("n_rows"), F.array(*entries).alias("e"))
                     .select("n_rows", F.inline("e")).withColumn("n_unique", F.lit(None).cast("bigint")))
    fields = df.schema.fields
    cells = [F.when(col(f.name).isNotNull(), F.struct(*[F.xxhash64(F.lit(salt), col(f.name)).alias(f"h{salt}") for salt in (1, 2)])) for f in fields]
    values = _by_column(df, cells).groupBy("c", F.col("v.h1").alias("h1"), F.col("v.h2").alias("h2")).agg(F.count("*").alias("n"))
    present = F.col("h1").isNotNull()
    counted = values.groupBy("c").agg(
        F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(~present, F.col("n"))), F.lit(0)).alias("n_missing"),
        F.count_if(present & (F.col("n") == 1)).alias("n_unique"), F.count("h1").alias("n_distinct"))
    # an empty table counts nothing, yet each column has its row
    known = F.array(*[F.struct(F.lit(str(i)).alias("c"), F.lit(f.name).alias("column_name"), F.lit(column_type(f.dataType)).alias("column_type"))
                      for i, f in enumerate(fields)])
    rows = df.sparkSession.range(1).select(F.inline(known)).join(counted, "c", "left")
    return shape(rows.na.fill(0, ["n_rows", "n_missing", "n_unique", "n_distinct"]))


def _value_range(v: Column) -> Column:
    """Number of the narrow range a value falls in, rising with the value; there are under 13 million."""
    def of(size: Column) -> Column:
        return F.when(size == float("inf"), _INFINITE).otherwise(F.floor(F.log(size) * OCTAVE_STEPS) + _ABOVE_ZERO)

    return (F.when(F.isnan(v), _NOT_A_NUMBER).when(v == 0, 0).when(v > 0, of(v)).otherwise(-of(-v))).cast("long")


def _holding(counts: DataFrame, group: Sequence[str], order: str, ranks: Column, base: Column) -> DataFrame:
    """The rows of ``counts`` that hold one of ``ranks``, with those ranks as ``held`` and the rows before them as ``before``."""
    running = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.withColumn("before", base + F.sum("n").over(running) - F.col("n"))
    inside = F.filter(ranks, lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n")))
    return placed.withColumn("held", inside).where(F.size("held") > 0)


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """Exact linearly interpolated quantiles, one row per column with an array ``q``.

    The built-in exact percentile gathers all distinct values in one buffer. Here ranks are
    looked for in three scans: counts of narrow ranges of values say which ranges hold a wanted
    rank, counts of equal parts of those ranges say which parts do, and only the values of
    those parts are counted singly. Range numbers rise with the values, so no rank is missed;
    a scan leaves at most a task's ranges to shuffle, and a part holds about a million doubles that differ.
    NaN ranks last; a column without values has no row.
    """
    long = _by_column(df, [col(c).cast("double") for c in columns]).where(F.col("v").isNotNull()).withColumn("k", _value_range(F.col("v")))

    def exact(p: float) -> Column:
        return F.lit(float(p)) * (F.col("total") - 1)

    wanted = F.array_distinct(F.array(*[r for p in probabilities for r in (F.floor(exact(p)), F.ceil(exact(p)))]))
    ranges = (long.groupBy("c", "k").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
              .withColumn("total", F.sum("n").over(Window.partitionBy("c"))))
    # at most two rows per column and probability, so both lists may be broadcast
    first = _holding(ranges, ["c"], "k", wanted, F.lit(0)).select("c", "k", "lo", "hi", "total", "held", "before")
    share = (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    part = F.when(F.col("lo") == F.col("hi"), F.lit(0)).otherwise(F.floor(share * RANGE_STEPS)).cast("long")
    parts = (long.join(F.broadcast(first), ["c", "k"]).groupBy("c", "k", part.alias("part"), "lo", "hi", "total", "before", "held").agg(F.count("*").alias("n"))
             .withColumnsRenamed({"before": "base", "held": "ranks"}))
    second = _holding(parts, ["c", "k"], "part", F.col("ranks"), F.col("base")).select("c", "k", "part", "lo", "hi", "total", "before", "held")
    values = (long.join(F.broadcast(second.withColumnRenamed("part", "at")), ["c", "k"]).where(part == F.col("at"))
              .groupBy("c", "k", "at", "v", "total", "before", "held").agg(F.count("*").alias("n")).withColumnsRenamed({"before": "base", "held": "ranks"}))
    picked = _holding(values, ["c", "k", "at"], "v", F.col("ranks"), F.col("base"))
    found = picked.select("c", "total", "v", F.explode("held").alias("rank")).groupBy("c", "total").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))

    def value(p: float) -> Column:
        low, high = F.col("at")[F.floor(exact(p))], F.col("at")[F.ceil(exact(p))]
        return low + (high - low) * (exact(p) - F.floor(exact(p)))

    names = F.array(*map(F.lit, columns))
    return found.select(names[F.col("c").cast("int")].alias("column_name"), F.array(*map(value, probabilities)).alias("q"))


def _moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Moments of every column; columns are rows, so that the code of a task is as long for one as for a thousand."""
    x = F.col("v")
    n = F.count(x).cast("double")
    g1, g2 = F.skewness(x), F.kurtosis(x)
    skew = F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3)))
    moments = _by_column(df, [col(c).cast("double") for c in columns]).groupBy("c").agg(
        F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"),
        kurt.alias("kurtosis"), skew.alias("skewness"), F.count(x).alias("n_values"))
    # an empty table has no moments, yet each column has its row
    names = df.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, columns))).alias("at", "column_name"))
    return names.withColumn("c", F.col("at").cast("string")).join(moments, "c", "left").drop("c", "at").na.fill(0, ["n_values"])


def descriptive(df: DataFrame, dataset: str, run_ts: str, columns: Sequence[str] | None = None,
                digits: int = 6) -> DataFrame:
    """Mean, deviation, range, quartiles and bias-corrected moments of numeric columns; 0 when undefined."""
    columns = list(columns or numeric_columns(df))
    joined = _moments(df, columns).join(exact_quantiles(df, columns, QUARTILES), "column_name", "left")
    picked = {"mean": F.col("mean"), "std": F.col("std"), "min": F.col("min"),
              "pct_25": F.col("q")[0], "median": F.col("q")[1], "pct_75": F.col("q")[2],
              "max": F.col("max"), "kurtosis": F.col("kurtosis"), "skewness": F.col("skewness")}
    return _run(joined.select("column_name", *[
        F.coalesce(F.round(F.nanvl(v, F.lit(0.0)), digits), F.lit(0.0)).alias(k) for k, v in picked.items()]), dataset, run_ts)


_SUMS = ("n", "sa", "sb", "saa", "sbb", "sab")


def _comoments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, sums over the rows that have both) of every pair of columns of one task.

    Values, squares and presence marks of a batch are multiplied as matrices; a task keeps four
    square matrices of the number of columns.
    """
    total = None
    for batch in batches:
        have = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
        x = np.column_stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in batch.columns])
        part = np.stack([have.T @ have, x.T @ have, (x * x).T @ have, x.T @ x])
        total = part if total is None else total + part
    if total is None:
        return
    n, s, ss, xy = total
    a, b = np.triu_indices(len(n), 1)
    columns = [a, b, n[a, b], s[a, b], s[b, a], ss[a, b], ss[b, a], xy[a, b]]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", *_SUMS])


def correlations(df: DataFrame, dataset: str, run_ts: str, columns: Sequence[str] | None = None,
                 digits: int = 6) -> DataFrame:
    """Pearson correlation of every pair of numeric columns, by name order; undefined pairs are left out.

    Each pair counts the rows that have both. Tasks build a matrix of co-moments about the column
    means, one row per pair and task is shuffled, and the plan is as long as the list of columns.
    A column with a NaN or infinite value has no correlations.
    """
    columns = sorted(columns or numeric_columns(df))
    means = df.agg(F.array(*[F.avg(col(c).cast("double")) for c in columns])).scalar() if columns else F.lit(None)
    shifted = df.select(*[(col(c).cast("double") - means[i]).alias(f"c{i}") for i, c in enumerate(columns)])
    sums = ", ".join(f"{c} double" for c in _SUMS)
    pairs = shifted.mapInArrow(_comoments, f"a long, b long, {sums}").groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in _SUMS])
    va, vb = (F.col("saa") - F.col("sa") * F.col("sa") / F.col("n"), F.col("sbb") - F.col("sb") * F.col("sb") / F.col("n"))
    # about its mean a value's squares are its variance; what is left of a constant is rounding
    spread = (va > F.col("saa") * RELATIVE_ZERO) & (vb > F.col("sbb") * RELATIVE_ZERO)
    value = (F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")) / (F.sqrt(va) * F.sqrt(vb))
    names = F.array(*map(F.lit, columns)).cast("array<string>")
    found = pairs.filter("n > 0").filter(spread).select(
        F.lit("pearson").alias("correlation_type"), names[F.col("a")].alias("column_a"), names[F.col("b")].alias("column_b"),
        F.round(value, digits).alias("correlation_value"))
    return _run(found.filter(~F.isnan("correlation_value")), dataset, run_ts)


def histogram(df: DataFrame, column: str, bins: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """Counts of equal-width bins; the last bin includes the upper bound."""
    x = col(column).cast("double")
    bounds = df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi")).alias("b")).scalar()
    lo = F.lit(float(low)) if low is not None else bounds.getField("lo")
    hi = F.lit(float(high)) if high is not None else bounds.getField("hi")
    spot = F.when(lo == hi, F.lit(1).cast("bigint")).otherwise(F.least(F.width_bucket(x, lo, hi, F.lit(bins)), F.lit(bins).cast("bigint")))
    return (df.filter(x.isNotNull()).select(spot.alias("bin")).filter("bin >= 1")
            .groupBy("bin").agg(F.count("*").alias("n")))


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k most frequent values, NULL not being one; ties go to the smaller value."""
    counted = df.filter(col(column).isNotNull()).groupBy(col(column).alias("value")).agg(F.count("*").alias("frequency"))
    return counted.orderBy(F.desc("frequency"), "value").limit(k)


def inventory(stats: DataFrame, pii_summary: DataFrame) -> DataFrame:
    """Column statistics with the PII findings of the same run, kept for columns without any."""
    keys = ["dataset_name", "run_timestamp", "column_name"]
    found = pii_summary.select(*keys, "is_pii", "detected_entity_types", "max_confidence")
    return stats.join(found, keys, "left")


def profile(df: DataFrame, dataset: str, run_ts: str) -> dict[str, DataFrame]:
    """The four history tables of one run."""
    return {
        "metadata_dataset_overview": overview(df, dataset, run_ts),
        "metadata_column_stats": column_stats(df, dataset, run_ts),
        "metadata_descriptive_stats": descriptive(df, dataset, run_ts),
        "metadata_correlations": correlations(df, dataset, run_ts),
    }
