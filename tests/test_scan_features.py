"""Signature scan, feature helpers, evaluation and anomaly jobs."""

import math
import re
from types import SimpleNamespace

import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from etlvault.operators import anomaly, features, scan
from etlvault.session import cut_lineage, scratch_path

SCRIPTS = [
    ("a/load.bteq", ".LOGON x\nSELECT a FROM stage.t1 JOIN core.t2 ON 1=1;\nCREATE MACRO m;"),
    ("b/proc.sql", "CREATE OR REPLACE PROCEDURE p AS INSERT INTO dw.f SELECT NVL(a,0) FROM src.s;\nEXEC usp_a\nEXEC usp_a\nCALL usp_b(1);"),
    ("c/stream.sql", "-- kafka cdc\nCREATE TABLE t (x VARBINARY);\nSELECT * FROM t; UPDATE \"t\" SET x = 1"),
    ("d/plain.txt", "nothing to see"),
    ("e/job.jcl", "//A JOB (X)\n//S EXEC PGM=SORT\n//I DD DSNAME=P.Q,RECFM=FB\nINTERVAL 5 MINUTE"),
]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(SCRIPTS, "path string, content string")


def test_labels(files):
    got = {r.filename: (r.platforms, r.formats, r.patterns) for r in scan.scan(files).collect()}
    assert got == {"load.bteq": (["teradata"], ["unknown"], ["batch"]), "proc.sql": (["oracle"], ["unknown"], ["batch"]),
                   "stream.sql": (["unknown"], ["blob"], ["realtime"]), "plain.txt": (["unknown"], ["unknown"], ["batch"]),
                   "job.jcl": (["mainframe"], ["fixed_width"], ["near_realtime"])}


def test_objects_and_scores(files):
    found = {(r.path, r.object_type, r.name): r.frequency for r in scan.objects(files).collect()}
    assert found[("a/load.bteq", "table", "stage.t1")] == 1 and found[("a/load.bteq", "table", "FROM stage.t1")] == 1
    assert found[("b/proc.sql", "stored_procedure", "EXEC usp_a")] == 2 and found[("b/proc.sql", "stored_procedure", "OR REPLACE")] == 1
    assert found[("b/proc.sql", "stored_procedure", "usp_b")] == 1
    assert ("c/stream.sql", "table", "t") not in found  # one letter is no name
    scores = {r.filename: (r.total_objects, r.complexity_score, r.complexity_level) for r in scan.scan(files).collect()}
    counted = {}
    for path, kind, _ in found:
        counted.setdefault(path.split("/")[1], []).append(kind)
    for name, (total, score, _) in scores.items():
        kinds = counted.get(name, [])
        base = sum(scan.WEIGHTS[k] for k in kinds)
        base = base * 1.8 if name == "stream.sql" else base * 1.4 if name == "job.jcl" else base
        base += 15 if name in ("stream.sql", "job.jcl") else 0
        assert total == len(kinds) and score == min(100, max(1, int(base / 5)))
    ranked = scan.prioritise(scan.scan(files)).collect()
    assert ranked[0].filename == "stream.sql" and ranked[0].priority_score == ranked[0].complexity_score + 40
    frequent = scan.frequent_objects(scan.objects(files))
    assert {(r.path, r.name) for r in frequent.collect()} >= {("b/proc.sql", "EXEC usp_a")}
    advice = scan.recommendations(scan.scan(files), frequent)
    assert advice.filter(F.col("recommendation").startswith("Start with the frequent")).count() >= 1
    assert scan.unique_recommendations(advice).count() == advice.select(F.left("recommendation", F.lit(60))).distinct().count()


def test_recommendations_in_one_pass(spark, files):
    more = files.unionByName(spark.createDataFrame([("f/none.sql", None), ("g/many.sql", "EXEC b\nEXEC a\nEXEC a\nEXEC b\nEXEC c\nEXEC d\nEXEC d\nEXEC e\nEXEC e")], files.schema))
    scanned = scan.scan(more, frequent=3)
    plain = scan.recommendations(scan.scan(more), scan.frequent_objects(scan.objects(more)))

    def rows(df):
        return sorted(tuple(r) for r in df.collect())
    assert rows(scan.recommendations(scanned)) == rows(plain)
    assert ("g/many.sql", "Start with the frequent stored_procedures: EXEC a, EXEC b, EXEC d") in rows(plain)
    assert rows(scanned.select("path", "total_objects", "complexity_score")) == rows(scan.scan(more).select("path", "total_objects", "complexity_score"))
    plan = scan.recommendations(scanned)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan


def test_level_bounds(spark):
    counts = [{"object_type": "jcl", "objects": n} for n in (22, 23, 38, 39)]
    df = spark.createDataFrame([(i, [c], ["batch"], ["unknown"]) for i, c in enumerate(counts)],
                               "i int, object_counts array<struct<object_type:string,objects:int>>, patterns array<string>, formats array<string>")
    assert [(r.complexity_score, r.complexity_level) for r in scan.with_complexity(df).orderBy("i").collect()] == [
        (39, "LOW"), (41, "MEDIUM"), (68, "MEDIUM"), (70, "HIGH")]


@pytest.mark.parametrize("pattern,want", [(r"\bCREATE\s+(OR\s+REPLACE\s+)?VIEW\b", "CREATE"), (r"REAL.?TIME", "REAL"), (r"KAFKA", "KAFKA"),
                                          (r"(?:EXEC(?:UTE)?|CALL)\s+x", ""), (r"DELIMITER\s*[=,]", "DELIMITER"), (r"//\w+\s+JOB\b", "JOB")])
def test_needle_is_part_of_every_match(pattern, want):
    assert scan.needle(pattern) == want


def test_needles_never_hide_a_match():
    """A text matching the signature always contains its literal, whatever the case."""
    samples = [t for _, t in SCRIPTS] + ["real-time API", "Near Real", "bulk_insert", "REST and api", "view v_x from V_a", "INCLUDE  member"]
    for table in (scan.PLATFORM_SIGNATURES, scan.FORMAT_SIGNATURES, scan.MOVEMENT_SIGNATURES, scan.OBJECT_SIGNATURES):
        for patterns in table.values():
            for p in patterns:
                for text in samples:
                    if re.search(p, text, re.IGNORECASE):
                        assert scan.needle(p) in text.upper()


def test_feature_columns(spark):
    df = spark.createDataFrame([("2024-01-01 02:30:00", "x@mail.com", "7"), ("2024-01-07 23:00:00", None, "bad"), ("nonsense", "none", None)],
                               "ts string, mail string, n string")
    t = features.coerce_timestamp(F.col("ts"))
    got = df.select(features.hour(t).alias("h"), features.day_of_week(t).alias("d"), features.email_domain(F.col("mail")).alias("m"),
                    features.coerce_number(F.col("n")).alias("n")).collect()
    assert [tuple(r) for r in got] == [(2, 0, "mail.com", 7.0), (23, 6, "unknown", None), (None, None, "unknown", None)]
    v = features.policy_violation(F.lit(3), F.lit("FALSE"))
    r = spark.range(1).select(v.alias("v"), features.policy_violation(F.lit(4), F.lit("FALSE")).alias("w"),
                              features.reward(v, F.lit(0)).alias("r"), features.reward(F.lit(0), F.lit(0)).alias("s")).collect()[0]
    assert tuple(r) == (1, 0, 0, 1)


def test_fills_and_buckets(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, None, None), (3, "a", 4.0), (4, "b", 3.0), (5, "c", 2.0)], "id int, c string, x double")
    assert [r.c for r in features.fill_constant(df).orderBy("id").collect()] == ["a", "missing", "a", "b", "c"]
    assert features.fill_median(df, ["x"]).filter("id = 2").collect()[0].x == 2.5
    top = features.bucket_top_k(features.fill_constant(df), "c", 2, "t")
    assert {r.id: r.t for r in top.collect()} == {1: "a", 2: "other", 3: "a", 4: "b", 5: "other"}


def test_evaluation_with_ties(spark):
    data = [(1, 1, .9), (0, 1, .9), (1, 0, .4), (0, 0, .4), (1, 1, .8), (0, 0, .1)]
    r = features.binary_evaluation(spark.createDataFrame(data, "y int, p int, s double"), "y", "p", "s").collect()[0]
    pairs = [(a[2] > b[2]) + .5 * (a[2] == b[2]) for a in data if a[0] for b in data if not b[0]]
    assert (r.tp, r.fp, r.fn, r.tn) == (2, 1, 1, 2) and r.precision == pytest.approx(2 / 3)
    assert r.auroc == pytest.approx(sum(pairs) / len(pairs))
    none = features.binary_evaluation(spark.createDataFrame([(0, 0)], "y int, p int"), "y", "p").collect()[0]
    assert (none.precision, none.recall) == (0.0, 0.0)


def test_anomaly_jobs_find_planted_outliers(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") < 20, 60.0 + F.col("id")).otherwise(F.hash("id") % 100 / 10).alias("x"),
                                  (F.hash(F.col("id") + 7) % 100 / 10).alias("y"), F.element_at(F.array(F.lit("a"), F.lit("b")), (F.col("id") % 2 + 1).cast("int")).alias("c"))
    model = anomaly.fit_features(df, ["x", "y"], ["c"])
    assert anomaly.feature_names(model, ["x", "y"], ["c"]) == ["x", "y", "c=a", "c=b"]
    vectors = model.transform(df).select("id", "x", "features")
    flagged = anomaly.weak_label(anomaly.reconstruction_flags(anomaly.isolation_flags(vectors, "id"), 1))
    flagged = cut_lineage(flagged)
    assert flagged.filter("id < 20").agg(F.avg("if_anomaly")).collect()[0][0] > 0.9
    assert flagged.filter("if_anomaly = 1").count() <= 0.06 * 2000
    again = anomaly.isolation_flags(vectors.repartition(5), "id")
    assert {(r.id, round(r.if_score, 9)) for r in again.collect()} == {(r.id, round(r.if_score, 9)) for r in flagged.collect()}
    train, test = anomaly.split(flagged, "id")
    assert train.count() + test.count() == 2000 and 0.75 < train.count() / 2000 < 0.85
    classifier = anomaly.fit_classifier(train, iterations=2, depth=2)
    result = features.binary_evaluation(anomaly.predict(classifier, test), "label", "prediction", "score")
    assert anomaly.comparison({"m": result}).count() == 3
    importance = anomaly.feature_importance(spark, classifier, ["x", "y", "c=a", "c=b"])
    assert importance.agg(F.sum("importance")).collect()[0][0] == pytest.approx(1.0)


def test_scratch_folder_follows_the_setting():
    def session(setting, current, master):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: setting),
                               sparkContext=SimpleNamespace(getCheckpointDir=lambda: current, master=master))

    assert scratch_path(session("/shared", None, "yarn"), "x").startswith("/shared/x-")
    assert scratch_path(session(None, "/given", "yarn"), "x").startswith("/given/x-")
    with pytest.raises(RuntimeError):
        scratch_path(session(None, None, "yarn"), "x")


def test_parts_of_the_event_frame_hold_a_bounded_number_of_rows(spark, monkeypatch):
    from etlvault.workload import feature_queries

    monkeypatch.setattr(feature_queries, "TASK_ROWS", 50, raising=False)
    sizes = feature_queries.event_frame(spark, "/root/testdata/sf0.001").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) <= 100


def test_trees_draw_rows_in_compiled_code_and_score_by_path_length(spark):
    rows = spark.range(400).select("id", F.array((F.col("id") % 37).cast("double"), F.when(F.col("id") == 7, F.lit(float("nan"))).otherwise(
        F.sin(F.col("id").cast("double")))).alias("a")).select("id", array_to_vector("a").alias("features"))
    drawn = anomaly.tree_samples(rows, "id", trees=5, rows=50, seed=3)
    assert "lambdafunction" not in drawn._jdf.queryExecution().optimizedPlan().toString()
    spelled = {(r["id"], t) for r in rows.select("id", *[(anomaly._uniform(F.lit(3), F.col("id").cast("string"), F.lit(t)) < 50 / 400).alias(f"t{t}") for t in range(5)]).collect()
               for t in range(5) if r[f"t{t}"]}
    assert {(r["id"], r["tree"]) for r in drawn.collect()} == spelled

    nodes = [(0, 0, 0, 10.0, 50), (0, 1, -1, 0.0, 2), (0, 2, 1, 0.5, 48), (0, 5, -1, 0.0, 40), (0, 6, -1, 0.0, 8), (1, 0, -1, 0.0, 1)]
    forest = spark.createDataFrame(nodes, "tree int, node int, feature int, split double, size int")
    normal = float(anomaly._expected_path([50, 1]).sum())
    got = {r["id"]: r["s"] for r in rows.withColumn("s", anomaly.isolation_score(spark, forest)(vector_to_array("features"))).collect()}
    for i, s in got.items():
        if i % 37 < 10:
            depth, size = 1, 2
        else:
            depth, size = 2, 8 if math.sin(i) >= 0.5 else 40
        assert math.isclose(s, 2.0 ** (-(depth + float(anomaly._expected_path([size])[0])) / normal), rel_tol=1e-12)


@pytest.mark.parametrize("pattern,want", [(r"\[dbo\]\.", ["[DBO]."]), (r"V\$\w+", ["V$"]), (scan.TABLE_REFERENCE, ["FROM", "JOIN", "INTO", "UPDATE", "TABLE"]),
                                          (scan.CALL_REFERENCE, ["EXEC", "CALL"]), (r"(?:a|b)?c", []), (r"x|y", [])])
def test_escaped_marks_and_alternatives_are_searched_before_the_pattern_runs(pattern, want):
    assert scan.needles(pattern) == want


def test_objects_keep_letters_of_all_scripts(spark):
    files = spark.createDataFrame([("a.txt", "call été\nUPDATE Éan")], "path string, content string")
    assert {(r["object_type"], r["name"]) for r in scan.objects(files).collect()} == {
        ("stored_procedure", "call été"), ("table", "Éan")}
