"""Feature preparation: fills, coercion, date parts, domains, top-k buckets, policy columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from etlvault.functions.columns import col, string_columns
from etlvault.operators.profile import exact_quantiles, top_values

MISSING, UNKNOWN, OTHER = "missing", "unknown", "other"
# Hours in which the policy forbids changes, the text flag of a live record, the domain pattern.
FORBIDDEN_HOURS = (0, 1, 2, 3)
NOT_DELETED = "FALSE"
DOMAIN_PATTERN = r"@([\w.-]+)"


def fill_constant(df: DataFrame, columns: Sequence[str] | None = None, value: str = MISSING) -> DataFrame:
    return df.na.fill(value, subset=list(columns or string_columns(df)))


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact medians, one row per column."""
    return exact_quantiles(df, columns, [0.5]).select("column_name", F.col("q")[0].alias("median"))


def fill_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Numeric NULLs replaced by the column's exact median."""
    wide = medians(df, columns).agg(F.map_from_entries(F.collect_list(F.struct("column_name", "median"))).alias("m"))
    # one map with an entry per column, read as a scalar
    found = wide.scalar()
    return df.withColumns({c: F.coalesce(col(c).cast("double"), found[c]) for c in columns})


def coerce_number(column: Column) -> Column:
    """Number, or NULL for text that is none."""
    return column.cast("string").try_cast("double")


def coerce_timestamp(column: Column) -> Column:
    return column.cast("string").try_cast("timestamp_ntz")


def hour(column: Column) -> Column:
    return F.hour(column)


def day_of_week(column: Column) -> Column:
    """Monday is 0."""
    return F.weekday(column)


def email_domain(column: Column) -> Column:
    found = F.regexp_extract(F.coalesce(column, F.lit("")), DOMAIN_PATTERN, 1)
    return F.when(found == "", UNKNOWN).otherwise(found)


def bucket_top_k(df: DataFrame, column: str, k: int = 10, name: str | None = None) -> DataFrame:
    """Keep the k most frequent values, put all others and NULL under ``other``; ties go to the smaller value."""
    # k rows by construction, so this side may be broadcast
    kept = F.broadcast(top_values(df, column, k).select(F.col("value").alias("__kept")))
    return df.join(kept, col(column).eqNullSafe(F.col("__kept")), "left").withColumn(
        name or column, F.coalesce("__kept", F.lit(OTHER))).drop("__kept")


def policy_violation(at_hour: Column, deleted_flag: Column) -> Column:
    return F.when(at_hour.isin(*FORBIDDEN_HOURS) & (deleted_flag == NOT_DELETED), 1).otherwise(0)


def reward(violation: Column, label: Column) -> Column:
    return (F.lit(1) - violation) * (F.lit(1) - label)


def binary_evaluation(df: DataFrame, label: str, prediction: str, score: str | None = None) -> DataFrame:
    """Confusion counts, precision and recall, and with a score the exact area under the ROC curve.

    The area comes from the counts per distinct score and a distributed running sum over
    them: each positive beats the negatives below it and half of those beside it.
    """
    from etlvault.operators.ordered import with_running_sum

    y, p = col(label) == 1, col(prediction) == 1
    tp, fp, fn, tn = (F.count_if(t).alias(n) for t, n in ((y & p, "tp"), (~y & p, "fp"), (y & ~p, "fn"), (~y & ~p, "tn")))
    counts = df.agg(tp, fp, fn, tn)
    out = counts.select("tp", "fp", "fn", "tn", F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)).alias("precision"),
                        F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0)).alias("recall"))
    if score is None:
        return out
    per = df.groupBy(col(score).cast("double").alias("s")).agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"))
    ranked = with_running_sum(per, ["s"], F.col("neg"), "upto")
    wins = F.sum((F.col("pos") * (F.col("upto") - F.col("neg") + F.col("neg") / 2)).cast("double"))
    area = ranked.agg(F.try_divide(wins, (F.sum("pos") * F.sum("neg")).cast("double")).alias("a")).scalar()
    return out.withColumn("auroc", area)
