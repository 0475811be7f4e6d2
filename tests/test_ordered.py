"""Skew-safe ordering helpers against plain windows, with one key holding most rows."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from etlvault.operators.ordered import first_by, order_bucket, order_cuts, with_neighbour, with_running_number, with_running_sum


def skewed(spark, n=3000):
    rng = random.Random(7)
    seen, data = set(), []
    for i in range(n):
        key = "hot" if rng.random() < 0.6 else f"k{rng.randrange(40)}"
        at = rng.randrange(200) * 7200 + rng.randrange(3000)
        if (key, at) not in seen:
            seen.add((key, at))
            data.append((key, at, f"v{rng.randrange(3)}"))
    return spark.createDataFrame(data, "k string, s bigint, v string").withColumn(
        "t", F.timestamp_seconds("s").cast("timestamp_ntz")).repartition(6)


def test_neighbours_match_the_plain_window(spark, rows):
    df = skewed(spark)
    for following in (False, True):
        for bucket in (1, 7, 1024, "HOUR", "DAY", "MONTH"):
            ours = with_neighbour(df, ["k"], "t", "v", "n", following=following, bucket=bucket)
            plain = with_neighbour(df, ["k"], "t", "v", "n", following=following, bucket=None)
            assert rows(ours, "k", "s", "v", "n") == rows(plain, "k", "s", "v", "n")


def test_neighbour_splits_the_hot_key(spark):
    plan = with_neighbour(skewed(spark), ["k"], "t", "v", "n")._jdf.queryExecution().toString()
    assert "windowspecdefinition(k#" in plan and "__order_bucket#" in plan


def test_a_key_dense_in_one_hour_is_cut_into_equal_runs(spark):
    """A third of all rows on one key within one hour; the others over a year."""
    hot = spark.range(4000).select(F.lit("hot").alias("k"), (F.col("id") * 900).alias("ms"))
    rest = spark.range(8000).select(F.concat(F.lit("k"), (F.col("id") % 50).cast("string")).alias("k"), (F.col("id") * 3_942_000).alias("ms"))
    df = hot.unionByName(rest).withColumn("t", F.timestamp_millis("ms").cast("timestamp_ntz")).withColumn("v", F.col("ms") % 3).repartition(6)
    cuts = order_cuts(df, "t", 48)
    spot = order_bucket(F.col("t"), cuts, "timestamp_ntz")
    groups = df.groupBy("k", spot.alias("b")).count()
    assert 40 <= len(cuts) <= 47 and groups.agg(F.max("count")).head()[0] <= 2 * 12_000 / 48
    assert groups.filter("k = 'hot'").count() >= 15
    order = [r["b"] for r in df.orderBy("t").select(spot.alias("b")).collect()]
    assert order == sorted(order)
    ours = with_neighbour(df, ["k"], "t", "v", "n", bucket=48)
    plain = with_neighbour(df, ["k"], "t", "v", "n", bucket=None)
    assert ours.exceptAll(plain).isEmpty() and plain.exceptAll(ours).isEmpty()


def test_cuts_of_no_rows_and_of_one_date(spark):
    empty = spark.createDataFrame([], "k string, t timestamp_ntz, v int")
    assert order_cuts(empty, "t") == [] and order_cuts(empty, "t", 1) == [] and with_neighbour(empty, ["k"], "t", "v", "n").collect() == []
    one = spark.range(50).select(F.col("id").alias("k"), F.lit("2024-01-01").cast("timestamp_ntz").alias("t"), F.lit(1).alias("v"))
    assert len(order_cuts(one, "t")) == 1 and {r.n for r in with_neighbour(one, ["k"], "t", "v", "n").collect()} == {None}


def test_running_sum_and_number(spark):
    df = spark.range(0, 5000).select(F.pmod(F.col("id") * 7919, F.lit(5000)).alias("x"), (F.col("id") % 5).alias("a")).repartition(7)
    data = sorted((r.x, r.a) for r in df.collect())
    total, want = 0, {}
    for i, (x, a) in enumerate(data):
        total += a
        want[x] = (total, i + 1)
    got = with_running_sum(df, ["x"], F.col("a"), "total").collect()
    assert {r.x: r.total for r in got} == {x: t for x, (t, _) in want.items()}
    numbered = with_running_number(df, ["x"], "n").collect()
    assert {r.x: r.n for r in numbered} == {x: n for x, (_, n) in want.items()}


def test_first_by_takes_one_whole_row(spark, rows):
    df = spark.createDataFrame([("a", 2, "x", None), ("a", 1, "z", "q"), ("a", 1, "y", "r"), ("b", 9, None, "s")],
                               "k string, o int, p string, q string")
    assert rows(first_by(df, ["k"], ["o", "p"])) == [("a", 1, "y", "r"), ("b", 9, None, "s")]
    w = Window.partitionBy("k").orderBy("o", "p", "q")
    assert rows(df.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")) == rows(first_by(df, ["k"], ["o", "p", "q"]))
