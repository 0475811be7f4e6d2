"""Agreement of two sets of metadata: coverage, mapping accuracy, lineage, weighted confidence.

Both sides meet in one aggregate per dimension, with a flag for the side a key comes from.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weight of each dimension in the confidence.
WEIGHTS = {"Table Coverage": 0.25, "Column Coverage": 0.25, "Mapping Accuracy": 0.30, "View Detection": 0.10, "Lineage Depth": 0.10}


class Metadata(NamedTuple):
    """Columns ``(table_name, column_name)``, mappings (4-part key, expression) and views ``(name)``."""

    columns: DataFrame
    mappings: DataFrame
    views: DataFrame


def normal_name(name: Column) -> Column:
    return F.upper(F.trim(name))


def normal_expression(expression: Column) -> Column:
    """Whitespace collapsed, upper-case, empty read as DIRECT."""
    return F.regexp_replace(F.upper(F.coalesce(F.nullif(expression, F.lit("")), F.lit("DIRECT"))), r"\s+", " ")


def _flags(ours: DataFrame, theirs: DataFrame, keys: Sequence[str]) -> DataFrame:
    def side(df: DataFrame, o: int, r: int) -> DataFrame:
        return df.select(*[normal_name(F.col(k)).alias(k) for k in keys], F.lit(o).alias("o"), F.lit(r).alias("r"))
    rows = side(ours, 1, 0).unionByName(side(theirs, 0, 1))
    return rows.filter(F.col(keys[0]) != "").groupBy(*keys).agg(F.max("o").alias("o"), F.max("r").alias("r"))


def _counts(flags: DataFrame) -> DataFrame:
    return flags.agg(*[F.coalesce(F.sum(e), F.lit(0)).alias(n) for n, e in (
        ("our_count", F.col("o")), ("ref_count", F.col("r")), ("matched", F.col("o") * F.col("r")))])


def _precision_recall(prefix: str = "") -> tuple[Column, Column]:
    """None of ours gives 0 and 0; none of theirs gives 1 and 1."""
    o, r, m = F.col(f"{prefix}our_count"), F.col(f"{prefix}ref_count"), F.col(f"{prefix}matched")

    def share(of: Column) -> Column:
        return F.when(o == 0, 0.0).when(r == 0, 1.0).otherwise(m / F.nullif(of, F.lit(0)))
    return share(o), share(r)


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, 0.0).otherwise(2 * p * r / F.nullif(p + r, F.lit(0.0)))


def _scored(counts: DataFrame, dimension: str) -> DataFrame:
    p, r = _precision_recall()
    union = F.col("our_count") + F.col("ref_count") - F.col("matched")
    jaccard = F.when(union == 0, 1.0).otherwise(F.col("matched") / F.nullif(union, F.lit(0)))
    return counts.select(F.lit(dimension).alias("dimension"), "our_count", "ref_count", "matched", F.round(p, 3).alias("precision"),
                         F.round(r, 3).alias("recall"), F.round(_f1(p, r), 3).alias("f1"), F.round(jaccard, 3).alias("jaccard"))


def set_score(ours: DataFrame, theirs: DataFrame, keys: Sequence[str], dimension: str) -> DataFrame:
    """Counts, precision, recall, F1 and Jaccard of two key sets."""
    return _scored(_counts(_flags(ours, theirs, keys)), dimension)


def _table_counts(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Columns of every table on our side, on theirs and on both."""
    flags = _flags(ours, theirs, ["table_name", "column_name"])
    return flags.groupBy("table_name").agg(F.sum("o").alias("our_count"), F.sum("r").alias("ref_count"), F.sum(F.col("o") * F.col("r")).alias("matched"))


def column_scores(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Column agreement of every table both sides have."""
    p, r = _precision_recall()
    return _table_counts(ours, theirs).filter("our_count > 0 AND ref_count > 0").select(
        "table_name", "our_count", "ref_count", "matched", _f1(p, r).alias("f1"))


def column_coverage(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Mean F1 over the common tables; 0 without any."""
    return column_scores(ours, theirs).agg(
        F.lit("Column Coverage").alias("dimension"), F.count("*").alias("tables_compared"),
        F.round(F.coalesce(F.avg("f1"), F.lit(0.0)), 3).alias("f1"))


MAPPING_KEY = ["source_table", "source_column", "target_table", "target_column"]


def _pairs(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """One row per 4-part key with the expressions of both sides; a key given several times has its greatest expression."""
    def side(df: DataFrame, mine: str, other: str) -> DataFrame:
        e = normal_expression(F.col("expression"))
        return df.select(*[F.upper(k).alias(k) for k in MAPPING_KEY], e.alias(mine), F.lit(None).cast("string").alias(other))
    return side(ours, "oe", "re").unionByName(side(theirs, "re", "oe")).groupBy(*MAPPING_KEY).agg(F.max("oe").alias("oe"), F.max("re").alias("re"))


_BOTH = "oe IS NOT NULL AND re IS NOT NULL"


def mapping_accuracy(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Agreement of 4-part mapping keys, and of the expressions on matched ones.

    Expressions agree when equal after normalising or when either is DIRECT. A key given
    several times counts once, with its greatest expression.
    """
    both = F.expr(_BOTH)
    agree = both & ((F.col("oe") == F.col("re")) | (F.col("oe") == "DIRECT") | (F.col("re") == "DIRECT"))
    counts = _pairs(ours, theirs).agg(F.count("oe").alias("our_count"), F.count("re").alias("ref_count"), F.count_if(both).alias("matched"),
                                      F.count_if(agree).alias("__ok"))
    pct = F.when(F.col("matched") == 0, 0.0).otherwise(F.round(F.col("__ok") * F.lit(100.0) / F.nullif("matched", F.lit(0)), 1))
    p, r = _precision_recall()
    return counts.select(F.lit("Mapping Accuracy").alias("dimension"), "our_count", "ref_count", "matched", F.round(p, 3).alias("precision"),
                         F.round(r, 3).alias("recall"), F.round(_f1(p, r), 3).alias("f1"), pct.alias("expression_match_pct"))


def _shares(totals: DataFrame, *ready: Column) -> DataFrame:
    """Dimension and F1 of every struct of counts, named after its dimension, in a row of totals; and ``ready`` ones."""
    def f1(name: str) -> Column:
        p, r = _precision_recall(f"`{name}`.")
        return F.struct(F.lit(name).alias("dimension"), F.round(_f1(p, r), 3).alias("f1"))

    return totals.select(F.inline(F.array(*[f1(c) for c, kind in totals.dtypes if kind.startswith("struct")], *ready)))


def _counts_of(ours: Column, theirs: Column, both: Column) -> Column:
    return F.struct(*[F.coalesce(c, F.lit(0)).cast("bigint").alias(n) for c, n in ((ours, "our_count"), (theirs, "ref_count"), (both, "matched"))])


def _table_and_column_shares(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Both from one aggregate of the columns."""
    o, t = F.col("our_count") > 0, F.col("ref_count") > 0
    p, r = _precision_recall()
    totals = _table_counts(ours, theirs).agg(
        _counts_of(F.count_if(o), F.count_if(t), F.count_if(o & t)).alias("Table Coverage"),
        F.round(F.coalesce(F.avg(F.when(o & t, _f1(p, r))), F.lit(0.0)), 3).alias("columns"))
    return _shares(totals, F.struct(F.lit("Column Coverage").alias("dimension"), F.col("columns").alias("f1")))


def _mapping_and_lineage_shares(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Both from one aggregate of the mappings: keys by pair of tables, then all pairs."""
    hops = _pairs(ours, theirs).groupBy(normal_name(F.col("source_table")).alias("s"), normal_name(F.col("target_table")).alias("t")).agg(
        F.count("oe").alias("o"), F.count("re").alias("r"), F.count_if(F.expr(_BOTH)).alias("m"))
    o, r, named = F.col("o") > 0, F.col("r") > 0, F.col("s") != ""
    return _shares(hops.agg(_counts_of(F.sum("o"), F.sum("r"), F.sum("m")).alias("Mapping Accuracy"),
                            _counts_of(F.count_if(o & named), F.count_if(r & named), F.count_if(o & r & named)).alias("Lineage Depth")))


def scores(ours: Metadata, theirs: Metadata) -> DataFrame:
    """F1 of all five dimensions, one row each; columns and mappings are read once for two dimensions each."""
    views = set_score(ours.views.select("name"), theirs.views.select("name"), ["name"], "View Detection").select("dimension", "f1")
    return reduce(DataFrame.unionByName, [
        _table_and_column_shares(ours.columns, theirs.columns), views, _mapping_and_lineage_shares(ours.mappings, theirs.mappings)])


def confidence(scored: DataFrame, tool: str) -> DataFrame:
    """Weighted sum of the dimension scores in percent, one decimal."""
    weights = F.create_map(*[F.lit(v) for pair in WEIGHTS.items() for v in pair])
    points = (weights[F.col("dimension")] * F.col("f1")).cast("decimal(12,8)")
    return scored.agg(F.lit(tool).alias("tool"), F.round(F.sum(points) * 100, 1).cast("double").alias("confidence"))
