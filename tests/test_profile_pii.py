"""Profiles with history, PII detection, masks, encryption and restore."""

import random
import re
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from etlvault.functions import masking
from etlvault.operators import pii, profile
from etlvault.sources import history

RUN, KEY = "2024-01-01", "0123456789abcdef"


@pytest.fixture(scope="module")
def staff(spark):
    return spark.createDataFrame(
        [(30.0, 5000.0, "HR", 1.5), (None, 6200.0, "IT", 3.0), (41.0, None, "IT", 7.25), (29.0, 4800.0, "HR", 0.5), (30.0, 5000.0, "HR", 1.5)],
        "age double, salary double, dept string, tenure double")


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_overview_and_columns(staff):
    r = profile.overview(staff, "d", RUN).collect()[0]
    assert (r.n_rows, r.n_cols, r.n_missing_cells, r.pct_missing_cells) == (5, 4, 2, 10.0)
    assert (r.n_duplicate_rows, r.n_duplicate_groups, r.pct_duplicate_rows, r.n_numeric_cols, r.n_categorical_cols) == (1, 1, 20.0, 3, 1)
    c = by(profile.column_stats(staff, "d", RUN), "column_name")
    assert (c["age"].n_missing, c["age"].n_unique, c["age"].n_distinct, c["age"].pct_unique) == (1, 2, 3, 40.0)
    assert c["dept"].column_type == "Categorical" and c["dept"].n_unique == 0 and c["dept"].n_distinct == 2
    approx = by(profile.column_stats(staff, "d", RUN, approximate=True), "column_name")
    assert approx["age"].n_distinct == 3 and approx["age"].n_unique is None
    assert by(profile.null_counts(staff), "column_name")["salary"].n_missing == 1


def test_descriptive_matches_pandas(staff):
    pdf = staff.toPandas()
    got = by(profile.descriptive(staff, "d", RUN), "column_name")
    for c in ("age", "salary", "tenure"):
        s, r = pdf[c].dropna(), got[c]
        want = [s.mean(), s.std(), s.min(), s.quantile(.25), s.median(), s.quantile(.75), s.max(), s.kurt(), s.skew()]
        have = [r["mean"], r["std"], r["min"], r["pct_25"], r["median"], r["pct_75"], r["max"], r["kurtosis"], r["skewness"]]
        assert have == pytest.approx(want, abs=1e-5)
    single = profile.descriptive(staff.limit(1), "d", RUN, ["tenure"]).collect()[0]
    assert (single["std"], single["skewness"], single["kurtosis"]) == (0.0, 0.0, 0.0)
    corr = {(r.column_a, r.column_b): r.correlation_value for r in profile.correlations(staff, "d", RUN).collect()}
    assert corr[("age", "tenure")] == pytest.approx(pdf["age"].corr(pdf["tenure"]), abs=1e-5)
    constant = staff.withColumn("age", F.lit(1.0))
    assert ("age", "tenure") not in {(r.column_a, r.column_b) for r in profile.correlations(constant, "d", RUN).collect()}


def test_quantiles_of_many_values_and_a_hot_one(spark):
    df = spark.range(20000).select(F.when(F.col("id") < 8000, 5.0).otherwise(F.hash("id") % 1000 + 0.5).alias("x"))
    want = df.toPandas()["x"].quantile([.01, .25, .5, .999]).tolist()
    assert profile.exact_quantiles(df, ["x"], [.01, .25, .5, .999]).collect()[0].q == pytest.approx(want)


def test_quantiles_by_rank_over_all_magnitudes(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=3000) * 10.0 ** rng.integers(-300, 300, 3000), np.full(2000, -7.0), np.zeros(50), 1e6 + np.arange(2000) * 1e-9,
                        [np.inf, -np.inf, 5e-324, -5e-324]])
    pdf = pd.DataFrame({"x": x, "y": np.where(np.arange(len(x)) % 3 == 0, None, np.arange(len(x)) % 11)})
    df = spark.createDataFrame(pdf.astype({"y": "float64"})).withColumn("y", F.nanvl("y", F.lit(None).cast("double"))).withColumn("z", F.lit(None).cast("double"))
    shares = [0, .001, .1, .25, .5, .5001, .77, .999, 1]
    got = {r.column_name: r.q for r in profile.exact_quantiles(df, ["x", "y", "z"], shares).collect()}
    ordered = np.sort(x)
    for p, v in zip(shares, got["x"]):
        rank = p * (len(x) - 1)
        low, high = ordered[int(np.floor(rank))], ordered[int(np.ceil(rank))]
        want = low + (high - low) * (rank - np.floor(rank))
        assert v == want or np.isnan(v) and np.isnan(want)
    assert got["y"] == pytest.approx(pdf["y"].astype(float).quantile(shares).tolist()) and "z" not in got
    nan = spark.createDataFrame([(1.0,), (float("nan"),), (2.0,)], "x double")
    assert profile.exact_quantiles(nan, ["x"], [0.5]).collect()[0].q == [2.0]
    assert profile.exact_quantiles(nan.limit(0), ["x"], [0.5]).collect() == []


def test_column_counts_take_one_scan_and_one_shuffle(spark, tmp_path):
    rows = [(i % 7, None if i % 5 == 0 else f"v{i % 50}", float(i), i % 2 == 0) for i in range(400)] + [(1, "once", -0.0, None)]
    spark.createDataFrame(rows, "a int, b string, c double, d boolean").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    stats = profile.column_stats(df, "d", RUN)
    got = by(stats, "column_name")
    pdf = pd.DataFrame(rows, columns=list("abcd"))
    for c in "abcd":
        n = pdf[c].dropna().value_counts()
        assert (got[c].n_missing, got[c].n_unique, got[c].n_distinct) == (pdf[c].isna().sum(), (n == 1).sum(), len(n))
    plan = profile.column_stats(df, "d", RUN)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("h1#") and plan.count("Generate inline") <= 2
    empty = by(profile.column_stats(df.limit(0), "d", RUN), "column_name")
    assert [(empty[c].n_missing, empty[c].n_distinct, empty[c].column_type) for c in "ab"] == [(0, 0, "Numeric"), (0, 0, "Categorical")]


def test_histogram_and_top_values(staff):
    assert [(r.bin, r.n) for r in profile.histogram(staff, "tenure", 2).orderBy("bin").collect()] == [(1, 4), (2, 1)]
    assert profile.histogram(staff.withColumn("tenure", F.lit(2.0)), "tenure", 3).collect()[0].n == 5
    assert [(r.value, r.frequency) for r in profile.top_values(staff, "dept", 1).collect()] == [("HR", 3)]


def test_history_appends_runs(spark, staff, tmp_path):
    target = str(tmp_path / "stats")
    for run, n in (("2024-01-01", 5), ("2024-01-02", 4)):
        assert history.append_history(profile.column_stats(staff.limit(n), "staff", run), target)
    assert history.append_history(profile.column_stats(staff, "other", RUN), target)
    assert not history.append_history(profile.column_stats(staff, "x", RUN).limit(0), target)
    rows = history.read_history(spark, target)
    assert rows.count() == 12 and history.read_history(spark, target, "staff").count() == 8
    assert {(r.dataset_name, r.run_timestamp) for r in history.latest_run(rows).collect()} == {("staff", "2024-01-02"), ("other", RUN)}
    assert history.latest_rows(rows, 3).count() == 3
    tables = profile.profile(staff, "staff", RUN)
    assert {t.count() for t in tables.values()} == {1, 3, 4}
    history.write_report(history.report_tables(tables["metadata_dataset_overview"], rows, {"staff": rows}), str(tmp_path / "rep"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "rep" / "staff")).count() == 12


LITERALS = [("EMAIL_ADDRESS", "alice@example.com", "*****@example.com"), ("US_SSN", "123-45-6789", "***-**-6789"),
            ("PHONE_NUMBER", "+1-800-555-0199", "*******0199"), ("CREDIT_CARD", "4111111111111111", "************1111"),
            ("IP_ADDRESS", "192.168.1.1", "*.*.*.1"), ("DATE_TIME", "1990-04-15", "1********5")]


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame([(i, v) for i, (_, v, _) in enumerate(LITERALS)], "id int, v string")


def test_each_entity_is_found_and_masked(cells):
    found = pii.detect(cells, "id").collect()
    assert {(r.row_id, r.entity_type, r.start_char, r.end_char) for r in found} == {
        (i, e, 0, len(v)) for i, (e, v, _) in enumerate(LITERALS)}
    masked = {r.row_index: r.v for r in pii.anonymise(cells, "d", RUN, "id").collect()}
    assert masked == {i: m for i, (_, _, m) in enumerate(LITERALS)}


def test_spans_neighbours_and_near_misses(spark):
    text = "é a@b.io,x@y.org; 10.0.0.1. id 123-45-67890 999.1.1.1 v1.2.3.4 4111 1111 1111 1112 4111 1111 1111 11111 call 7 (212) 555-0100 5"
    df = spark.createDataFrame([(1, text), (2, "  "), (3, None)], "id int, t string")
    hits = [(r.entity_type, text[r.start_char:r.end_char], r.confidence) for r in pii.detect(df, "id").collect()]
    assert sorted(hits) == [("EMAIL_ADDRESS", "a@b.io", 1.0), ("EMAIL_ADDRESS", "x@y.org", 1.0), ("IP_ADDRESS", "10.0.0.1", 0.95), ("PHONE_NUMBER", "(212) 555-0100", 0.75)]
    loose = pii.detect(df, "id", threshold=0.2)
    assert sorted(text[r.start_char:r.end_char] for r in loose.filter("entity_type <> 'EMAIL_ADDRESS'").collect()) == [
        "(212) 555-0100", "10.0.0.1", "4111 1111 1111 1112", "999.1.1.1"]


def test_own_recogniser(spark):
    tag = pii.Recogniser("BADGE", r"[A-Z0-9]+", r"^B[0-9]{4}$", 0.9, "B[0-9]")
    df = spark.createDataFrame([(1, "B1234 XB1234 B12345")], "id int, t string")
    assert [(r.start_char, r.end_char) for r in pii.detect(df, "id", recognisers=[tag]).collect()] == [(0, 5)]


@pytest.mark.parametrize("rule,value,want", [
    (masking.mask_generic, "ab", "**"), (masking.mask_generic, "abc", "a*c"), (masking.mask_email, "no-at", "n***t"),
    (masking.mask_card, "4111-1111 1111-1111", "************1111"), (masking.mask_ssn, "12", "***-**-****"),
    (masking.mask_phone, "a12", "***"), (masking.mask_ip, "1.2.3", "*.*.*.*")])
def test_mask_edges(spark, rule, value, want):
    assert spark.range(1).select(rule(F.lit(value)).alias("m")).collect()[0].m == want


def test_encrypt_restore_and_wrong_key(spark):
    df = spark.createDataFrame([(1, "a@b.io and c@d.io", "HR"), (2, "nothing", "IT"), (3, "10.0.0.1", None)], "id int, note string, dept string")
    sealed = pii.vault_cells(df, "id", "d", RUN, "k1", KEY)
    assert sealed.count() == 3 and sealed.select("encrypted_value").distinct().count() >= 2
    hidden = pii.anonymise(df, "d", RUN, "id")
    back = pii.restore(hidden, "id", sealed, ["note", "dept"], KEY)
    assert {(r.column_name, r.cells, r.mismatches) for r in pii.roundtrip_check(df, back, "id", ["note", "dept"]).collect()} == {
        ("note", 3, 0), ("dept", 2, 0)}
    wrong = pii.restore(hidden, "id", sealed, ["note", "dept"], "fedcba9876543210")
    assert {r.id: r.n_unopened for r in wrong.collect()} == {1: 1, 2: 0, 3: 1}
    assert {r.mismatches for r in pii.roundtrip_check(df, wrong, "id", ["note"]).collect()} == {2}
    registry = pii.key_registry(spark, sealed, "d", RUN, "k1", KEY)
    assert registry.collect()[0].entities_covered == "EMAIL_ADDRESS, IP_ADDRESS"
    for frame in (sealed, back, registry):
        assert KEY not in frame._jdf.queryExecution().toString()
    assert history.latest_key(registry, "d").collect()[0].key_id == "k1"


def test_column_summary_covers_clean_columns(spark, cells):
    df = cells.withColumn("clean", F.lit("abc"))
    s = by(pii.column_summary(pii.detect(df, "id"), df, "d", RUN), "column_name")
    assert s["v"].n_entity_types == 6 and s["v"].pct_flagged_rows == 100.0 and s["v"].min_confidence == 0.6
    assert not s["clean"].is_pii and s["clean"].detected_entity_types is None and s["clean"].n_flagged_rows == 0
    assert pii.flagged_columns(pii.column_summary(pii.detect(df, "id"), df, "d", RUN)).count() == 1


def test_long_runs_do_not_overflow(spark):
    runs = ["-".join(["ab"] * 200_000) + " 123-45-6789", ".".join(["12"] * 200_000) + " 10.0.0.1", "call 555.123.4567 " + ".".join(["7"] * 200_000)]
    got = pii.detect(spark.createDataFrame(list(enumerate(runs)), "id long, v string"), "id").select("row_id", "entity_type").collect()
    assert {(0, "US_SSN"), (1, "IP_ADDRESS"), (2, "PHONE_NUMBER")} <= {tuple(r) for r in got}


PLAIN_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")


def test_anchored_emails_equal_a_plain_search(spark):
    draw = random.Random(5)
    texts = ["".join(draw.choice("ab.@-é x1") for _ in range(draw.randint(0, 40))) for _ in range(1500)]
    texts += ["a@b.com@c.org", "a@b.comx@c.org y", "@a.bc", "a@@b.cd", "x@y.c", "ünï@b.de q@r.st, u+v%w@x-y.co.uk.", "a.b@c..de", "p@q.rs1", "🙂a@b.cd"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, v string")
    email = [r for r in pii.RECOGNISERS if r.anchor]
    got = {(r.row_id, r.start_char, r.end_char) for r in pii.detect(df, "id", recognisers=email).collect()}
    assert got == {(i, m.start(), m.end()) for i, t in enumerate(texts) for m in PLAIN_EMAIL.finditer(t)}


def test_long_cells_are_read_in_linear_time(spark):
    def seconds(filler):
        found = pii.detect(spark.createDataFrame([(1, f"{filler} me@site.org 10.0.0.1")], "id long, v string"), "id")
        hits = {(r.entity_type, r.end_char - r.start_char) for r in found.collect()}
        assert {("EMAIL_ADDRESS", 11), ("IP_ADDRESS", 8)} <= hits
        started = time.perf_counter()
        found.collect()
        return time.perf_counter() - started

    # letters alone, then fillers full of dots, hyphens and anchors; a pattern that restarts takes minutes
    assert seconds("a" * 1_000_000) < 2
    for part in ("1-", "@", "x@y"):
        assert seconds(part * (1_000_000 // len(part))) < 6, part


def test_custom_anchor(spark):
    handle = pii.Recogniser("HANDLE", "[a-z]", "[0-9]+", 0.9, "#", anchor="#")
    df = spark.createDataFrame([(1, "ab#12 #3 X c#d e#4#5")], "id long, v string")
    assert sorted((r.start_char, r.end_char) for r in pii.detect(df, "id", recognisers=[handle]).collect()) == [(0, 5), (15, 18)]


def test_correlations_of_many_columns_with_gaps(spark):
    draw = np.random.default_rng(3)
    base = draw.normal(size=(400, 1))
    data = pd.DataFrame(base + draw.normal(size=(400, 200)) * draw.uniform(0.1, 3, size=200) + 1e6, columns=[f"c{i:03}" for i in range(200)])
    data = data.mask(draw.random(data.shape) < 0.2)
    data["c000"], data["c001"], data["c002"] = 0.1, None, np.arange(400) + 1e9
    schema = ", ".join(f"{c} double" for c in data.columns)
    df = spark.createDataFrame(data.astype(object).where(data.notna(), None).values.tolist(), schema).repartition(6)
    got = {(r.column_a, r.column_b): r.correlation_value for r in profile.correlations(df, "d", RUN).collect()}
    want = data.astype(float).corr().stack()
    want = {(a, b): v for (a, b), v in want.items() if a < b}
    assert {k for k in want if k[0] not in ("c000", "c001")} == set(got)  # constant and empty columns have none
    assert all(abs(want[k] - v) < 2e-6 for k, v in got.items())


def test_correlations_of_no_rows_and_few_columns(spark):
    empty = spark.createDataFrame([], "a double, b int, c string")
    assert profile.correlations(empty, "d", RUN).collect() == []
    assert profile.correlations(empty.select("a"), "d", RUN).collect() == []
    pair = spark.createDataFrame([(1.0, 2), (2.0, 4), (None, 9)], "a double, b int")
    assert [r.correlation_value for r in profile.correlations(pair, "d", RUN).collect()] == [1.0]
