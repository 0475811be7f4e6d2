"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from etlvault.llm.common import cut


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node that has an edge; root is the least node of its component.

    Each round hangs larger neighbours under the least one, first seen from both ends of an
    edge, then from the larger end. Edges never outgrow the input, minima are aggregated
    before the shuffle, and no component is ever gathered. Rounds grow with the logarithm of
    the longest path.
    """
    u, v, m = F.col("u"), F.col("v"), F.col("m")
    table = cut(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = _mark(table)
    while before[0]:
        both = table.select("u", "v").unionByName(table.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(v > u).select(v.alias("u"), m.alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(v > m).select(v.alias("u"), m.alias("v"))
        table = cut(small.unionByName(least.select("u", m.alias("v"))).distinct())
        after = _mark(table)
        if after == before:
            break
        before = after
    roots = table.select(v.alias("node"), v.alias("root")).distinct()
    return table.select(u.alias("node"), v.alias("root")).unionByName(roots)


def _mark(table: DataFrame) -> tuple[int, int]:
    """Row count and an order-free sum of hashes, to tell whether a round changed anything."""
    return tuple(table.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 32) - 1))), F.lit(0))).head())
