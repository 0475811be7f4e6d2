"""Reconciliation and quality rules on the small source and target frames."""

import random

import pytest
from pyspark.sql import functions as F

from etlvault.operators import quality, recon

SCHEMA = "CUSTOMER_ID int, FIRST_NAME string, EMAIL string, COUNTRY_CODE string, ORDER_AMOUNT decimal(18,2), STATUS string"


@pytest.fixture(scope="module")
def source(spark):
    rng = random.Random(42)
    from decimal import Decimal
    data = [(1000 + i, f"First_{i}", f"user{i}@example.com", rng.choice(["US", "GB", "CA"]),
             Decimal(str(round(rng.uniform(10, 5000), 2))), rng.choice(["ACTIVE", "INACTIVE", "PENDING"])) for i in range(1, 101)]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def target(source):
    return source.filter("CUSTOMER_ID <= 1095").withColumn("RECORD_SOURCE", F.lit("CRM"))


def one(df):
    return df.collect()[0]


def test_row_counts(source, target):
    r = one(recon.row_counts(source, target))
    assert (r.source_count, r.target_count, r.difference, r.pct_difference, r.status) == (100, 95, 5, 5.0, "FAIL")
    assert one(recon.row_counts(source, source)).status == "PASS"
    assert one(recon.row_counts(source.limit(0), target)).pct_difference == 0.0


def test_keys(source, target):
    r = one(recon.key_check(source, target, "customer_id"))
    assert (r.missing_in_target, r.extra_in_target, r.sample_missing, r.sample_extra, r.status) == (
        5, 0, ["1096", "1097", "1098", "1099", "1100"], [], "FAIL")
    assert one(recon.key_check(source, source, "CUSTOMER_ID")).status == "PASS"
    assert one(recon.key_check(source, target, "NO_SUCH")).status == "SKIPPED"
    assert recon.extra_keys(target, source, "CUSTOMER_ID").count() == 5
    assert recon.common_keys(source, target, "CUSTOMER_ID").count() == 95


def test_aggregates(source, target):
    got = {r["aggregate"]: r for r in recon.aggregate_compare(source, target, ["ORDER_AMOUNT"]).collect()}
    assert got["SUM"].status == "FAIL" and got["COUNT"].pct_diff == 5.0
    assert {r.status for r in recon.aggregate_compare(source, source, ["ORDER_AMOUNT"]).collect()} == {"PASS"}
    absent = recon.aggregate_compare(source, target.drop("ORDER_AMOUNT"), ["ORDER_AMOUNT"]).collect()
    assert {(r.target_value, r.pct_diff) for r in absent} == {(0.0, 100.0)}


def test_cells_and_hashes_find_exactly_what_was_broken(source, target, rows):
    broken = target.withColumn("ORDER_AMOUNT", F.when(F.col("CUSTOMER_ID") == 1005, F.lit(0)).otherwise(F.col("ORDER_AMOUNT")).cast("decimal(18,2)")).withColumn(
        "EMAIL", F.when(F.col("CUSTOMER_ID") != 1010, F.col("EMAIL")))
    found = recon.value_mismatches(source, broken, "CUSTOMER_ID")
    assert rows(found, "key", "column", "mismatch_type") == [
        ("1005", "ORDER_AMOUNT", "VALUE_DIFFERENCE"), ("1010", "EMAIL", "NULL_DIFFERENCE")]
    check = one(recon.value_check(source, broken, "CUSTOMER_ID"))
    assert (check.rows_compared, check.mismatches_found, check.status) == (95, 2, "FAIL")
    assert rows(recon.hash_mismatches(source, broken, "CUSTOMER_ID"), "key") == [("1005",), ("1010",)]
    # hashing each side's own columns, the extra column makes every row differ
    assert recon.hash_mismatches(source, broken, "CUSTOMER_ID", columns="all").count() == 95
    assert one(recon.hash_check(source, broken, "x")).status == "SKIPPED"


def test_typed_and_string_comparison(spark, rows):
    a = spark.createDataFrame([(1, 1), (2, 2)], "k int, v int")
    b = spark.createDataFrame([(1, 1.0), (2, 3.0)], "k bigint, v double")
    assert rows(recon.value_mismatches(a, b, "k"), "key") == [("2",)]
    assert rows(recon.value_mismatches(a, b, "k", as_strings=True), "key") == [("1",), ("2",)]


def test_duplicated_keys_are_listed_not_compared(spark, rows):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (None, "n")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "q")], "k int, v string")
    assert rows(recon.value_mismatches(a, b, "k"), "key") == [("2",)]
    assert rows(recon.duplicate_keys(a, ["k"])) == [(1, 2)]
    last = a.withColumn("o", F.when(F.col("v") == "x", 2).otherwise(1))
    other = b.withColumn("o", F.lit(9))
    got = recon.row_hashes(last, other, "k", columns=["v"], order_by="o").filter("source_hash = target_hash")
    assert rows(got, "key") == [("1",)]


def test_whole_report(source, target):
    report = recon.reconcile(source, target, "CUSTOMER_ID", ["ORDER_AMOUNT"], "2024-01-01")
    assert one(recon.summarise(report)).asDict() == {"total_checks": 7, "passed": 2, "failed": 5, "skipped": 0}
    same = recon.reconcile(source, source, "CUSTOMER_ID", ["ORDER_AMOUNT"], "2024-01-01")
    assert one(recon.summarise(same)).passed == 7 and recon.failed(same).count() == 0


def test_rules_on_broken_frame(source):
    bad = source.withColumn("EMAIL", F.when(~F.col("CUSTOMER_ID").isin(1005, 1010), F.col("EMAIL"))).withColumn(
        "ORDER_AMOUNT", F.when(F.col("CUSTOMER_ID") == 1020, F.lit("-99.99")).otherwise(F.col("ORDER_AMOUNT")).cast("decimal(18,2)"))
    rules = [{"rule_id": str(i), "dimension": "X", **r} for i, r in enumerate([
        {"column": "customer_id", "check_type": "NOT_NULL"}, {"column": "CUSTOMER_ID", "check_type": "UNIQUE"},
        {"column": "EMAIL", "check_type": "REGEX", "pattern": quality.EMAIL_PATTERN},
        {"column": "ORDER_AMOUNT", "check_type": "RANGE", "min_value": 0}, {"column": "EMAIL", "check_type": "NOT_NULL", "threshold": 2},
        {"column": "EMAIL", "check_type": "UNIQUE"}, {"column": "FAX", "check_type": "NOT_NULL"}, {"column": "EMAIL", "check_type": "NEW_KIND"},
        {"column": "EMAIL", "check_type": "REGEX", "pattern": "("}, {"column": "EMAIL", "check_type": "REGEX"}])]
    got = {r.rule_id: (r.actual_failures, r.pass_rate, r.status) for r in quality.evaluate(bad, rules, "c").collect()}
    assert got == {"0": (0, 100.0, "PASS"), "1": (0, 100.0, "PASS"), "2": (0, 100.0, "PASS"), "3": (1, 99.0, "FAIL"), "4": (2, 98.0, "PASS"),
                   "5": (2, 98.0, "FAIL"), "6": (0, 100.0, "SKIPPED"), "7": (0, 100.0, "SKIPPED"), "8": (0, 0.0, "ERROR"), "9": (0, 0.0, "ERROR")}
    assert one(quality.summarise(quality.evaluate(bad, rules, "c"))).overall_pass_pct == 66.67


def test_empty_table_passes(source):
    r = one(quality.evaluate(source.limit(0), [{"rule_id": "1", "dimension": "D", "column": "EMAIL", "check_type": "NOT_NULL"}]))
    assert (r.rows_checked, r.pass_rate, r.status) == (0, 100.0, "PASS")


def test_coercion_never_fails(spark):
    df = spark.createDataFrame([("12",), ("-3",), ("abc",), (None,), ("2999-01-01",), ("1850-01-01",)], "v string")
    rules = [{"rule_id": "n", "dimension": "D", "column": "v", "check_type": "RANGE", "min_value": 0, "max_value": 10},
             {"rule_id": "d", "dimension": "D", "column": "v", "check_type": "DATE_RANGE", "min_date": "1900-01-01", "max_date": "2024-01-01"},
             {"rule_id": "f", "dimension": "D", "column": "v", "check_type": "DATE_FORMAT", "format": "yyyy-MM-dd"},
             {"rule_id": "a", "dimension": "D", "column": "v", "check_type": "ACCEPTED_VALUES", "values": ["12", "abc"]}]
    got = {r.rule_id: r.actual_failures for r in quality.evaluate(df, rules).collect()}
    assert got["n"] == 2 and got["f"] == 3 and got["a"] == 3 and got["d"] >= 2


def test_reference_rule_and_learned_values(spark):
    child = spark.createDataFrame([(1,), (2,), (2,), (9,), (9,), (9,), (None,)], "k int")
    parent = spark.createDataFrame([(1,), (2,)], "id int")
    rule = {"rule_id": "1", "dimension": "D", "column": "k", "check_type": "REFERENTIAL_INTEGRITY", "ref_table": "p", "ref_column": "id"}
    r = one(quality.evaluate(child, [rule], parents={"p": parent}))
    assert (r.rows_checked, r.actual_failures, r.status) == (7, 3, "FAIL")
    assert one(quality.evaluate(child, [rule])).status == "SKIPPED"
    rule["check_type"] = "ACCEPTED_VALUES"
    r = one(quality.evaluate(child, [rule], parents={"p": parent}))
    assert (r.rows_checked, r.actual_failures, r.status) == (7, 3, "FAIL")
    assert one(quality.evaluate(child, [rule], parents={"p": spark.range(20_000).toDF("id")})).status == "PASS"
    assert quality.dimensions(spark).count() == 6


def test_cells_are_fetched_for_differing_keys_only(spark, rows):
    """Digests against a plain comparison: NULLs that change places, signed zeros, NaN, copies of a key, keys on one side."""
    nan = float("nan")
    left = [(1, "a", None, 0.0), (2, None, "a", 1.0), (3, "x", "y", nan), (4, "x", "y", 2.0), (5, "d", "d", 3.0), (5, "d", "d", 3.0),
            (6, "q", "r", None), (None, "n", "n", 0.0), (8, "only", "left", 1.0)]
    right = [(1, None, "a", -0.0), (2, None, "a", 1.0), (3, "x", "y", nan), (4, "x", "z", 2.5), (5, "e", "d", 3.0), (6, "q", "r", 0.0), (None, "m", "n", 0.0), (9, "", "", 0.0)]
    schema = "id int, p string, q string, v double"
    source, target = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    want = [("1", "p", "a", None, "NULL_DIFFERENCE"), ("1", "q", None, "a", "NULL_DIFFERENCE"), ("4", "q", "y", "z", "VALUE_DIFFERENCE"),
            ("4", "v", "2.0", "2.5", "VALUE_DIFFERENCE"), ("6", "v", None, "0.0", "NULL_DIFFERENCE")]
    for buckets in (None, 1, 3, 1 << 16):
        assert rows(recon.value_mismatches(source, target, "id", buckets=buckets)) == sorted(want, key=str)
    check = recon.value_check(source, target, "id", sample=2).collect()[0]
    assert (check.rows_compared, check.mismatches_found, [tuple(m) for m in check.sample_mismatches]) == (5, 5, want[:2])
    report = {r["check"]: r for r in recon.reconcile(source, target, "id", [], "t").collect()}
    assert (report["VALUE_MISMATCH"].source_value, report["VALUE_MISMATCH"].abs_diff) == (5.0, 5.0)


def test_equal_buckets_are_not_shuffled(spark):
    source = spark.range(20_000).select("id", (F.col("id") * 7).alias("v"))
    target = source.withColumn("v", F.when(F.col("id") == 777, F.lit(0)).otherwise(F.col("v")))
    digests = recon._union([recon._row_digests(d, ["v"], s) for d, s in zip(recon._sides(source, target, "id", ["v"], False), (1, 0))])
    assert recon._differing_buckets(digests, 1024).count() == 1
    assert [r["__key"] for r in recon.differing_keys(source, target, "id", ["v"], buckets=1024).collect()] == ["777"]
    assert recon.differing_keys(source, source, "id", ["v"], buckets=1024).isEmpty()


def test_hash_check_lists_the_first_keys(spark):
    source = spark.range(50).select("id", F.lit("a").alias("v"))
    target = source.withColumn("v", F.when(F.col("id") >= 30, "b").otherwise("a"))
    check = recon.hash_check(source, target, "id", sample=3).collect()[0]
    assert (check.rows_compared, check.hash_mismatches, check.sample_diff_keys, check.status) == (50, 20, ["30", "31", "32"], "FAIL")
