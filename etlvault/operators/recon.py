"""Source-to-target reconciliation.

Both sides go into one frame with a side marker and meet in one hash aggregate on the
key. Partial aggregation shrinks repeated keys before the shuffle, so neither a hot key
nor a duplicated one gathers in a task, and one exchange serves both directions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from etlvault.functions.columns import col, cols, common_columns, resolve
from etlvault.functions.hashing import row_digest

_SIDE = "__side"
DEFAULT_TOLERANCE_PCT = 0.001
SAMPLE_KEYS, SAMPLE_MISMATCHES, LISTING_LIMIT = 10, 20, 100


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def delta(df: DataFrame, column: str, since: str, until: str) -> DataFrame:
    """The rows loaded in a window; the filter reaches the scan."""
    stamp = F.lit(since).cast(df.schema[column].dataType), F.lit(until).cast(df.schema[column].dataType)
    return df.filter((col(column) >= stamp[0]) & (col(column) < stamp[1]))


def row_counts(source: DataFrame, target: DataFrame) -> DataFrame:
    """Row counts of both sides, their difference and its percentage."""
    sides = source.select(F.lit(1).alias("s"), F.lit(0).alias("t")).union(target.select(F.lit(0), F.lit(1)))
    diff = F.col("source_count") - F.col("target_count")
    return (
        sides.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("source_count"),
                  F.coalesce(F.sum("t"), F.lit(0)).alias("target_count"))
        .select(
            F.lit("ROW_COUNT").alias("check"), "source_count", "target_count", diff.alias("difference"),
            F.when(F.col("source_count") > 0,
                   F.round(F.abs(diff) * F.lit(100.0) / F.col("source_count"), 4)).otherwise(F.lit(0.0))
            .alias("pct_difference"),
            F.when(diff == 0, "PASS").otherwise("FAIL").alias("status"),
            F.when(diff == 0, F.lit("Row counts match."))
            .when(diff > 0, F.format_string(
                "%d rows missing in target. Check filters, rejected records and truncation.", diff))
            .otherwise(F.format_string(
                "%d rows extra in target. Check filters, rejected records and truncation.", -diff))
            .alias("recommendation"))
    )


def null_counts(source: DataFrame, target: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULLs per column and layer."""
    def side(df: DataFrame, layer: str) -> DataFrame:
        return df.agg(F.lit(layer).alias("layer"), F.count("*").alias("row_count"),
                      *[F.count_if(col(c).isNull()).alias(f"null_{c}_count") for c in columns])
    return _union([side(source, "SOURCE"), side(target, "TARGET")])


def checksums(source: DataFrame, target: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sums and averages per layer, SOURCE and TARGET one below the other."""
    def side(df: DataFrame, layer: str) -> DataFrame:
        totals = [F.sum(col(c)).alias(f"sum_{c}") for c in columns]
        means = [F.avg(col(c)).alias(f"avg_{c}") for c in columns]
        return df.agg(F.lit(layer).alias("layer"), *totals, *means)
    return _union([side(source, "SOURCE"), side(target, "TARGET")])


def aggregate_compare(source: DataFrame, target: DataFrame, columns: Sequence[str],
                      tolerance_pct: float = DEFAULT_TOLERANCE_PCT) -> DataFrame:
    """SUM, AVG and COUNT of the non-null values per column, compared within a tolerance.

    Pass money columns as decimals: their sums do not depend on the order of addition.
    """
    def side(df: DataFrame, marker: str) -> DataFrame:
        measures = []
        for c in columns:
            present = resolve(df, c)
            value = col(present) if present else F.lit(None).cast("double")
            total = F.coalesce(F.sum(value).cast("double"), F.lit(0.0))
            count = F.count(value)
            mean = F.when(count > 0, total / count).otherwise(F.lit(0.0))
            for label, measure in (("SUM", total), ("AVG", mean), ("COUNT", count.cast("double"))):
                measures.append(F.struct(F.lit(c).alias("column"), F.lit(label).alias("aggregate"), measure.alias("v")))
        return df.agg(F.array(*measures).alias("m")).select(F.inline("m")).withColumn(_SIDE, F.lit(marker))

    # a handful of rows from here on: one per column, aggregate and side
    both = side(source, "S").unionByName(side(target, "T"))
    pair = both.groupBy("column", "aggregate").agg(
        F.max(F.when(F.col(_SIDE) == "S", F.col("v"))).alias("s"),
        F.max(F.when(F.col(_SIDE) == "T", F.col("v"))).alias("t"))
    return _with_tolerance(pair, tolerance_pct)


def _with_tolerance(pair: DataFrame, tolerance_pct: float, keep: Sequence[str] = ()) -> DataFrame:
    """Compare rows ``(column, aggregate, s, t)`` within a percentage of the source value."""
    diff = F.abs(F.col("s") - F.col("t"))
    pct = F.when(F.col("s") != 0, diff / F.nullif(F.abs(F.col("s")), F.lit(0.0)) * 100).when(
        F.col("t") == 0, F.lit(0.0)).otherwise(F.lit(100.0))
    status = F.when(F.col("pct") <= tolerance_pct, "PASS").otherwise("FAIL")
    return pair.withColumn("pct", pct).select(
        F.concat(F.lit("AGGREGATE_"), F.col("aggregate")).alias("check"), "column", "aggregate",
        F.round("s", 4).alias("source_value"), F.round("t", 4).alias("target_value"),
        F.round(diff, 4).alias("abs_diff"), F.round("pct", 6).alias("pct_diff"),
        F.lit(float(tolerance_pct)).alias("tolerance_pct"), status.alias("status"),
        F.when(status == "PASS", F.format_string("%s(%s) matches within tolerance.", "aggregate", "column"))
        .otherwise(F.format_string(
            "%s(%s) is outside the tolerance. Check NULL handling, rounding and missing rows.", "aggregate", "column"))
        .alias("recommendation"), *keep)


def key_presence(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Every distinct non-null key, as a string, with the sides it occurs on."""
    def side(df: DataFrame, s: int, t: int) -> DataFrame:
        value = col(resolve(df, key)).cast("string")
        return df.select(value.alias("key"), F.lit(s).alias("s"), F.lit(t).alias("t")).filter(F.col("key").isNotNull())
    return (side(source, 1, 0).union(side(target, 0, 1)).groupBy("key")
            .agg(F.max("s").alias("in_source"), F.max("t").alias("in_target")))


def missing_keys(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Source keys absent from the target."""
    return key_presence(source, target, key).filter("in_source = 1 AND in_target = 0").select("key")


def extra_keys(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Target keys absent from the source."""
    return key_presence(source, target, key).filter("in_source = 0 AND in_target = 1").select("key")


def common_keys(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Keys on both sides."""
    return key_presence(source, target, key).filter("in_source = 1 AND in_target = 1").select("key")


def _skipped(df: DataFrame, check: str, key: str, extra: Mapping[str, T.DataType]) -> DataFrame:
    return df.sparkSession.range(1).select(
        F.lit(check).alias("check"), *[F.lit(None).cast(t).alias(n) for n, t in extra.items()],
        F.lit("SKIPPED").alias("status"), F.lit(f"Key column '{key}' not found").alias("recommendation"))


def _sample(keys: DataFrame, n: int, name: str) -> DataFrame:
    """The n smallest keys as one sorted array; n is a report size, so the list is bounded."""
    return keys.orderBy("key").limit(n).agg(F.sort_array(F.collect_list("key")).alias(name))


def key_check(source: DataFrame, target: DataFrame, key: str, sample: int = SAMPLE_KEYS) -> DataFrame:
    """Missing and extra key counts with a sorted sample; SKIPPED without the key column."""
    texts = T.ArrayType(T.StringType())
    shape = {"missing_in_target": T.LongType(), "extra_in_target": T.LongType(),
             "sample_missing": texts, "sample_extra": texts}
    if resolve(source, key) is None or resolve(target, key) is None:
        return _skipped(source, "MISSING_KEYS", key, shape)
    presence = key_presence(source, target, key)
    lost = _sample(missing_keys(source, target, key), sample, "k").scalar()
    added = _sample(extra_keys(source, target, key), sample, "k").scalar()
    counted = presence.agg(F.count_if(F.col("in_target") == 0).alias("missing_in_target"),
                           F.count_if(F.col("in_source") == 0).alias("extra_in_target"))
    clean = (F.col("missing_in_target") == 0) & (F.col("extra_in_target") == 0)
    return counted.select(
        F.lit("MISSING_KEYS").alias("check"), "missing_in_target", "extra_in_target",
        lost.alias("sample_missing"), added.alias("sample_extra"),
        F.when(clean, "PASS").otherwise("FAIL").alias("status"),
        F.when(clean, F.lit("All keys matched.")).otherwise(F.format_string(
            "%d keys missing in target, %d extra. Check load failures, key generation and stale data.",
            "missing_in_target", "extra_in_target")).alias("recommendation"))


def duplicate_keys(df: DataFrame, keys: Sequence[str], limit: int | None = None) -> DataFrame:
    """Keys held by more than one row; ``limit`` gives the sorted report form."""
    found = df.groupBy(*cols(keys)).agg(F.count("*").alias("duplicate_count")).filter("duplicate_count > 1")
    return found if limit is None else found.orderBy(*cols(keys)).limit(limit)


_WIDENING = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _shared_type(left: T.DataType, right: T.DataType) -> T.DataType:
    """Type both sides are compared in: equal types as they are, numbers widened, else strings."""
    if left == right:
        return left
    if isinstance(left, _WIDENING) and isinstance(right, _WIDENING):
        return T.LongType()
    if isinstance(left, T.DecimalType) and isinstance(right, (T.DecimalType, *_WIDENING)) or (
            isinstance(right, T.DecimalType) and isinstance(left, _WIDENING)):
        scale = max(getattr(t, "scale", 0) for t in (left, right))
        return T.DecimalType(38, scale)
    if isinstance(left, T.NumericType) and isinstance(right, T.NumericType):
        return T.DoubleType()
    return T.StringType()


def _typed(df: DataFrame, other: DataFrame, columns: Sequence[str], as_strings: bool) -> list[Column]:
    """The columns in the type both sides are compared in, under their given names."""
    values = []
    for c in columns:
        mine, theirs = resolve(df, c), resolve(other, c)
        kind = T.StringType() if as_strings else _shared_type(df.schema[mine].dataType, other.schema[theirs].dataType)
        values.append(col(mine).cast(kind).alias(c))
    return values


def _digest(values: Sequence[Column], kinds: Sequence[T.DataType], salt: int = 0) -> Column:
    """64-bit digest of some cells: equal cells give equal digests, NULL is a value of its own."""
    plain = [v + F.lit(0.0) if isinstance(k, (T.DoubleType, T.FloatType)) else v for v, k in zip(values, kinds, strict=True)]  # -0.0 equals 0.0
    missing = F.concat(*[F.when(v.isNull(), "1").otherwise("0") for v in values]) if values else F.lit("")
    return F.xxhash64(F.lit(salt), missing, *plain)


def _sides(source: DataFrame, target: DataFrame, key: str, columns: Sequence[str], as_strings: bool) -> list[DataFrame]:
    """(key, typed columns) of both sides, rows without a key left out."""
    out = []
    for df, other in ((source, target), (target, source)):
        named = df.select(col(resolve(df, key)).cast("string").alias("__key"), *_typed(df, other, columns, as_strings))
        out.append(named.filter(F.col("__key").isNotNull()))
    return out


def _row_digests(side: DataFrame, columns: Sequence[str], s: int) -> DataFrame:
    """(key, side, two digests of the row, cells apart): what stands for a row until it is known to differ."""
    kinds = [side.schema[c].dataType for c in columns]
    cells = [col(c) for c in columns]
    return side.select("__key", F.lit(s).alias(_SIDE), _digest(cells, kinds, 1).alias("__h1"), _digest(cells, kinds, 2).alias("__h2"))


def _differing_buckets(digests: DataFrame, buckets: int) -> DataFrame:
    """Buckets of keys whose rows are not the same on both sides, by counts and sums of digests.

    Sums do not depend on order; digests are added as halves, so that no sum can overflow.
    """
    low = F.lit((1 << 32) - 1)
    sign = F.when(F.col(_SIDE) == 1, F.lit(1)).otherwise(F.lit(-1)).cast("bigint")
    keyed = [F.xxhash64("__key", h) for h in ("__h1", "__h2")]
    halves = [half for h in keyed for half in (h.bitwiseAND(low), F.shiftrightunsigned(h, 32))]
    sums = digests.groupBy(F.pmod(F.xxhash64("__key"), F.lit(buckets)).alias("__bucket")).agg(
        F.sum(sign).alias("n"), *[F.sum(sign * h).alias(f"s{i}") for i, h in enumerate(halves)])
    return sums.filter(" OR ".join(f"{c} <> 0" for c in ("n", "s0", "s1", "s2", "s3"))).select("__bucket")


def differing_keys(source: DataFrame, target: DataFrame, key: str, columns: Sequence[str], as_strings: bool = False,
                   buckets: int | None = None) -> DataFrame:
    """Keys found once on each side whose rows differ, by digests alone.

    The shuffle carries a key and 16 bytes a row. With ``buckets`` one more scan first sums
    digests per bucket of keys, a table of at most that many rows, and only keys of buckets
    that differ are shuffled: for large tables that are nearly equal.
    """
    sides = _sides(source, target, key, columns, as_strings)
    both = _union([_row_digests(side, columns, s) for side, s in zip(sides, (1, 0), strict=True)])
    if buckets:
        spot = F.pmod(F.xxhash64("__key"), F.lit(buckets)).alias("__bucket")
        # no more rows than buckets
        both = both.withColumn("__bucket", spot).join(F.broadcast(_differing_buckets(both, buckets)), "__bucket", "left_semi").drop("__bucket")
    is_source = F.col(_SIDE) == 1
    found = both.groupBy("__key").agg(F.count_if(is_source).alias("ns"), F.count_if(~is_source).alias("nt"), *[
        F.max(F.when(is_source if s == "s" else ~is_source, F.col(f"__{h}"))).alias(f"{h}{s}") for h in ("h1", "h2") for s in "st"])
    return found.filter("ns = 1 AND nt = 1 AND (h1s <> h1t OR h2s <> h2t)").select("__key")


def value_mismatches(source: DataFrame, target: DataFrame, key: str, columns: Sequence[str] | None = None,
                     as_strings: bool = False, buckets: int | None = None) -> DataFrame:
    """Every differing cell of the keys found once on each side.

    Typed comparison after widening by default, string forms with ``as_strings``. Rows are
    fetched for the keys whose digests differ, and only there cells are compared.
    Keys held by several rows have no single counterpart; ``duplicate_keys`` lists them.
    """
    columns = list(columns or common_columns(source, target, [key]))
    keys = differing_keys(source, target, key, columns, as_strings, buckets)
    both = _union([side.select("__key", F.lit(n).alias(_SIDE), F.struct(*cols(columns)).alias("__row"))
                   for side, n in zip(_sides(source, target, key, columns, as_strings), (1, 0), strict=True)])
    is_source = F.col(_SIDE) == 1
    pairs = both.join(keys, "__key", "left_semi").groupBy(F.col("__key").alias("key")).agg(
        F.max(F.when(is_source, F.col("__row"))).alias("s"), F.max(F.when(~is_source, F.col("__row"))).alias("t"))
    cells = []
    for c in columns:
        a, b = F.col("s").getField(c), F.col("t").getField(c)
        kind = F.when(a.isNull() != b.isNull(), F.lit("NULL_DIFFERENCE")).when(a != b, F.lit("VALUE_DIFFERENCE"))
        cells.append(F.struct(F.lit(c).alias("column"), a.cast("string").alias("source_value"),
                              b.cast("string").alias("target_value"), kind.alias("mismatch_type")))
    return pairs.select("key", F.inline(F.array(*cells))).filter(F.col("mismatch_type").isNotNull())


def mismatch_types(mismatches: DataFrame) -> DataFrame:
    return mismatches.groupBy("column", "mismatch_type").agg(F.count("*").alias("cells"))


def row_hashes(source: DataFrame, target: DataFrame, key: str, columns: Sequence[str] | str | None = None,
               scales: Mapping[str, int] | None = None, order_by: str | None = None) -> DataFrame:
    """Row digests of both sides for the keys they share.

    ``columns`` defaults to the common columns without the key in name order; ``"all"``
    hashes each side's own columns. For a duplicated key the row last in ``order_by``
    counts, or the greatest digest when no order is given.
    """
    def side(df: DataFrame, s: int) -> DataFrame:
        if columns == "all":
            names = df.columns
        else:
            names = [resolve(df, c) for c in (columns or sorted(common_columns(source, target, [key])))]
        digest = row_digest(names, scales)
        rank = col(order_by) if order_by else digest
        return df.select(col(resolve(df, key)).cast("string").alias("key"), F.lit(s).alias(_SIDE),
                         F.struct(rank.alias("r"), digest.alias("h")).alias("d")).filter(F.col("key").isNotNull())

    is_source = F.col(_SIDE) == 1
    return (
        side(source, 1).unionByName(side(target, 0)).groupBy("key")
        .agg(F.max(F.when(is_source, F.col("d"))).getField("h").alias("source_hash"),
             F.max(F.when(~is_source, F.col("d"))).getField("h").alias("target_hash"))
        .filter("source_hash IS NOT NULL AND target_hash IS NOT NULL")
    )


def hash_mismatches(source: DataFrame, target: DataFrame, key: str, **options) -> DataFrame:
    """Shared keys whose row digests differ."""
    return row_hashes(source, target, key, **options).filter("source_hash <> target_hash")


def _listed(rows: DataFrame, order: Sequence[str], n: int) -> Column:
    """The first n rows in a total order as one array; n is a report size, so the list is bounded."""
    first = rows.orderBy(*order).limit(n)
    return first.agg(F.sort_array(F.collect_list(F.struct(*order, *[c for c in rows.columns if c not in order])))).scalar()


def hash_check(source: DataFrame, target: DataFrame, key: str, sample: int = SAMPLE_KEYS, **options) -> DataFrame:
    """Rows compared and rows differing by digest, with the first differing keys."""
    if resolve(source, key) is None or resolve(target, key) is None:
        return _skipped(source, "HASH_COMPARISON", key, {"rows_compared": T.LongType(), "hash_mismatches": T.LongType(),
                                                         "sample_diff_keys": T.ArrayType(T.StringType())})
    hashes = row_hashes(source, target, key, **options)
    found = hashes.agg(F.count("*").alias("rows_compared"), F.count_if(F.col("source_hash") != F.col("target_hash")).alias("hash_mismatches"))
    keys = _sample(hashes.filter("source_hash <> target_hash").select("key"), sample, "k").scalar()
    clean = F.col("hash_mismatches") == 0
    return found.select(
        F.lit("HASH_COMPARISON").alias("check"), "rows_compared", "hash_mismatches", keys.alias("sample_diff_keys"),
        F.when(clean, "PASS").otherwise("FAIL").alias("status"),
        F.when(clean, F.lit("All row hashes matched.")).otherwise(F.format_string(
            "%d rows have differing hashes. Run the value check to find the columns.", "hash_mismatches"))
        .alias("recommendation"))


_MISMATCH = "array<struct<key:string,column:string,source_value:string,target_value:string,mismatch_type:string>>"


def value_check(source: DataFrame, target: DataFrame, key: str, columns: Sequence[str] | None = None,
                as_strings: bool = False, sample: int = SAMPLE_MISMATCHES) -> DataFrame:
    """Rows compared and cells differing, with the first mismatches by key and column."""
    if resolve(source, key) is None or resolve(target, key) is None:
        return _skipped(source, "VALUE_MISMATCH", key, {"rows_compared": T.LongType(), "mismatches_found": T.LongType(),
                                                        "sample_mismatches": T._parse_datatype_string(_MISMATCH)})
    columns = list(columns or common_columns(source, target, [key]))
    is_source = F.col(_SIDE) == 1
    keys = _union([side.select("__key", F.lit(s).alias(_SIDE)) for side, s in zip(_sides(source, target, key, [], as_strings), (1, 0), strict=True)])
    compared = keys.groupBy("__key").agg(F.count_if(is_source).alias("ns"), F.count_if(~is_source).alias("nt")).agg(
        F.count_if((F.col("ns") == 1) & (F.col("nt") == 1)).alias("rows_compared"))
    cells = value_mismatches(source, target, key, columns, as_strings)
    counted = compared.withColumn("mismatches_found", cells.agg(F.count("*")).scalar())
    clean = F.col("mismatches_found") == 0
    return counted.select(
        F.lit("VALUE_MISMATCH").alias("check"), "rows_compared", "mismatches_found", _listed(cells, ["key", "column"], sample).alias("sample_mismatches"),
        F.when(clean, "PASS").otherwise("FAIL").alias("status"),
        F.when(clean, F.lit("All values matched for compared rows.")).otherwise(F.format_string(
            "%d value mismatches found. Review the transformation of the affected columns.", "mismatches_found"))
        .alias("recommendation"))


_REPORT = ("check", "column", "aggregate", "source_value", "target_value", "abs_diff", "pct_diff", "tolerance_pct", "status", "recommendation")


def reconcile(source: DataFrame, target: DataFrame, key: str, numeric: Sequence[str], run_ts: str,
              columns: Sequence[str] | None = None, scales: Mapping[str, int] | None = None,
              tolerance_pct: float = DEFAULT_TOLERANCE_PCT) -> DataFrame:
    """All five checks as one long result table.

    Each side is scanned once and shuffled once: one hash aggregate per key holds the row
    counts, a 64-bit digest of every cell and the row digest of both sides and the partial
    sums, all of fixed width, and one aggregate over the keys turns them into every figure
    of the report. Of a repeated key's row digests the one with the greatest number counts.
    """
    keyed = resolve(source, key) is not None and resolve(target, key) is not None
    columns = list(columns or common_columns(source, target, [key]))
    hashed = sorted(common_columns(source, target, [key]))

    def side(df: DataFrame, other: DataFrame, s: int) -> DataFrame:
        def cell(i: int, c: str) -> Column:
            kind = _shared_type(df.schema[resolve(df, c)].dataType, other.schema[resolve(other, c)].dataType)
            return _digest([col(resolve(df, c)).cast(kind)], [kind]).alias(f"__v{i}")

        numbers = [(col(resolve(df, c)) if resolve(df, c) else F.lit(None).cast("double")).alias(f"__n{i}") for i, c in enumerate(numeric)]
        name = (col(resolve(df, key)).cast("string") if keyed else F.lit(None).cast("string")).alias("key")
        return df.select(name, F.lit(s).alias(_SIDE), *[cell(i, c) for i, c in enumerate(columns)],
                         F.xxhash64(row_digest([resolve(df, c) for c in hashed], scales)).alias("__h"), *numbers)

    is_source, slots = F.col(_SIDE) == 1, range(len(numeric))
    both = side(source, target, 1).unionByName(side(target, source, 0))

    def of(value: str, s: bool) -> Column:
        return F.when(is_source if s else ~is_source, F.col(value))

    per_key = both.groupBy("key").agg(
        F.count_if(is_source).alias("ns"), F.count_if(~is_source).alias("nt"),
        *[F.max(of(f"__v{i}", s)).alias(f"v{i}{'s' if s else 't'}") for i in range(len(columns)) for s in (True, False)],
        F.max(of("__h", True)).alias("hs"), F.max(of("__h", False)).alias("ht"),
        *[f(of(f"__n{i}", s)).alias(f"{n}{i}{'s' if s else 't'}") for i in slots for s in (True, False) for n, f in (("t", F.sum), ("c", F.count))])
    named = F.col("key").isNotNull()
    pair = named & (F.col("ns") == 1) & (F.col("nt") == 1)
    differing: Column = F.lit(0)
    for i in range(len(columns)):
        differing = differing + (F.col(f"v{i}s") != F.col(f"v{i}t")).cast("int")
    zero = F.lit(0)
    totals = per_key.agg(
        F.coalesce(F.sum("ns"), zero).alias("ns"), F.coalesce(F.sum("nt"), zero).alias("nt"),
        F.count_if(named & (F.col("nt") == 0)).alias("lost"), F.count_if(named & (F.col("ns") == 0)).alias("added"),
        F.count_if(pair).alias("pairs"), F.coalesce(F.sum(F.when(pair, differing)), zero).alias("cells"),
        F.count_if(named & (F.col("ns") > 0) & (F.col("nt") > 0)).alias("hashed"),
        F.count_if(named & (F.col("hs") != F.col("ht"))).alias("changed"),
        *[F.coalesce(F.sum(f"{n}{i}{s}").cast("double"), F.lit(0.0)).alias(f"{n}{i}{s}") for i in slots for s in "st" for n in "tc"])

    blank = F.lit(None).cast("double")

    def row(check: str, values: Sequence[Column], passed: Column, text: Column) -> Column:
        sv, tv, diff, pct = [v.cast("double") for v in values]
        status = F.when(passed, "PASS").otherwise("FAIL") if keyed or check == "ROW_COUNT" else F.lit("SKIPPED")
        parts = (F.lit(check), F.lit(None).cast("string"), F.lit(None).cast("string"), sv, tv, diff, pct, blank, status, text)
        return F.struct(*[v.alias(n) for v, n in zip(parts, _REPORT)])

    def advice(passed: Column, good: str, bad: str, *numbers: str) -> Column:
        return F.when(passed, F.lit(good)).otherwise(F.format_string(bad, *numbers)) if keyed else F.lit(f"Key column '{key}' not found")

    gap = F.abs(F.col("ns") - F.col("nt"))
    same_rows, same_keys = gap == 0, (F.col("lost") == 0) & (F.col("added") == 0)
    same_cells, same_hashes = F.col("cells") == 0, F.col("changed") == 0
    gap_pct = F.when(F.col("ns") > 0, F.round(gap * F.lit(100.0) / F.nullif("ns", zero), 4)).otherwise(F.lit(0.0))
    checks = F.array(
        row("ROW_COUNT", (F.col("ns"), F.col("nt"), gap, gap_pct), same_rows,
            F.when(same_rows, F.lit("Row counts match.")).otherwise(F.lit("Row counts differ. Check filters, rejected records and truncation."))),
        row("MISSING_KEYS", (F.col("lost"), F.col("added"), blank, blank), same_keys, advice(
            same_keys, "All keys matched.", "%d keys missing in target, %d extra. Check load failures, key generation and stale data.", "lost", "added")),
        row("VALUE_MISMATCH", (F.col("pairs"), blank, F.col("cells"), blank), same_cells, advice(
            same_cells, "All values matched for compared rows.", "%d value mismatches found. Review the transformation of the affected columns.", "cells")),
        row("HASH_COMPARISON", (F.col("hashed"), blank, F.col("changed"), blank), same_hashes, advice(
            same_hashes, "All row hashes matched.", "%d rows have differing hashes. Run the value check to find the columns.", "changed")))

    def measure(i: int, label: str, s: str) -> Column:
        total, count = F.col(f"t{i}{s}"), F.col(f"c{i}{s}")
        return {"SUM": total, "COUNT": count}.get(label, F.when(count > 0, total / F.nullif(count, F.lit(0.0))).otherwise(F.lit(0.0)))

    measures = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(a).alias("aggregate"), measure(i, a, "s").alias("s"), measure(i, a, "t").alias("t"))
        for i, c in enumerate(numeric) for a in ("SUM", "AVG", "COUNT")]) if numeric else None
    stamp = F.lit(run_ts).alias("run_ts")
    if measures is None:
        return totals.select(F.inline(checks)).select(stamp, *_REPORT)
    # the one row of totals becomes all rows at once, so it is computed once
    empty = F.array().cast("array<struct<column:string,aggregate:string,s:double,t:double>>")
    blocks = totals.select(F.explode(F.array(
        F.struct(checks.alias("done"), empty.alias("open")), F.struct(F.slice(checks, 1, 0).alias("done"), measures.alias("open")))).alias("b"))
    compared = blocks.select(F.col("b.done").alias("done"), F.explode_outer("b.open").alias("m")).select("done", "m.*")
    rows = _with_tolerance_rows(compared, tolerance_pct)
    return rows.select(stamp, *_REPORT)


def _with_tolerance_rows(compared: DataFrame, tolerance_pct: float) -> DataFrame:
    """Rows of finished checks as they are, rows of open measures compared."""
    made = _with_tolerance(compared.withColumn("__done", F.col("done")), tolerance_pct, keep=["__done"])
    entry = F.struct(*[F.col(c).alias(c) for c in _REPORT])
    return made.select(F.inline(F.when(F.col("aggregate").isNotNull(), F.array(entry)).otherwise(F.col("__done"))))


def summarise(checks: DataFrame) -> DataFrame:
    """Totals by status."""
    return checks.agg(F.count("*").alias("total_checks"), *[
        F.count_if(F.col("status") == s).alias(n)
        for s, n in (("PASS", "passed"), ("FAIL", "failed"), ("SKIPPED", "skipped"))])


def failed(checks: DataFrame) -> DataFrame:
    return checks.filter(F.col("status") == "FAIL")
