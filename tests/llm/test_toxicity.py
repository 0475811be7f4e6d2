import numpy as np
from pyspark.sql import functions as F

from etlvault.llm.toxicity import Matcher, Model, drop_toxic, fit, fold, score


def test_fold_undoes_disguises():
    assert fold("ＴＲＡＳＨ, tr4sh tra$h trаsh Träsh_1diot") == " trash trash trash trash trash ldiot "
    assert fold("cost $ 5 or !") == " cost s or " and fold("") == "  "


def test_matcher_and_brute_force():
    weights, exceptions = {" idio": 2.0, " idiot ": 3.0, " scum ": 1.5}, [" useful idiot ", " pond scum "]
    m = Matcher(weights, exceptions)
    rng = np.random.default_rng(0)
    words = np.array(["idiot", "idiots", "scum", "scummy", "useful", "pond", "an"])
    for _ in range(200):
        text = " " + " ".join(rng.choice(words, rng.integers(0, 9))) + " "
        want = {}
        for at in [i for i, c in enumerate(text) if c == " "]:
            best = max((w for e, w in weights.items() if text.startswith(e, at)), default=0)
            inside = any(text.startswith(e, s) and s <= at < s + len(e) - 1 for e in exceptions for s in range(len(text)))
            if best and not inside:
                want[at] = best
        assert m.hits(text) == want
    assert Matcher({}).hits(" any ") == {}


def corpus(spark, n=400):
    rng = np.random.default_rng(1)
    base = [f"{i:05d}w" for i in range(20_000)]
    rows, labels = [], []
    for i in range(n):
        words = list(rng.choice(base, 60))
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words[rng.integers(60)] = rng.choice(["grobnak", "Gr0bnak", "zulfert"])
        if i % 40 == 1:
            words[5:7] = ["noble", "zulfert"]
        rows.append((i, " ".join(words), "x", i))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, score string, __id long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    model = fit(docs.drop("__id"), labels)
    got = score(docs.drop("__id"), model).join(labels, "doc_id").where("held_out")
    assert got.where("predicted <> toxic").count() == 0 and got.where("toxic = 1").count() > 5
    assert {r.doc_id for r in drop_toxic(docs, model).collect()} == {r.doc_id for r in labels.where("toxic = 0").collect()}


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "a", 1), (2, "", None, 1), (2, "", None, 1), (None, "zz " * 100_000, "", 1), (4, "$$$ ###", "", 1)],
                                 "doc_id long, text string, label string, toxic int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = fit(docs, none)
    assert model.weights == {} and [r.predicted for r in score(docs, model).collect()] == [0] * 5
    some = Model({" zz ": 3.0}, [], (1.0, 0.0, -3.0))
    got = score(docs, some).groupBy("doc_id").agg(F.max("predicted").alias("p"), F.count("*").alias("n")).collect()
    assert sorted((r.doc_id or 0, r.p, r.n) for r in got) == [(0, 1, 1), (1, 0, 1), (2, 0, 2), (4, 0, 1)]
    assert drop_toxic(docs, some).columns == docs.columns
    assert score(docs.limit(0), some).count() == 0
