import numpy as np
import pyarrow as pa

from etlvault.llm.langid import Model, fit, identify, subwords, train
from etlvault.llm.common import mix, text_bytes

WORDS = {"xx": ["blorp", "grund", "zek", "mov", "über"], "yy": ["lalie", "esou", "que", "amie", "été"], "zz": ["катя", "мод", "сон", "дом"]}


def corpus(spark, n=300):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        lang = list(WORDS)[i % 3]
        rows.append((i, " ".join(rng.choice(WORDS[lang], 1 + i % 40)), lang if i % 7 else None, "s", lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, truth string")


def test_subwords_by_hand():
    data, offsets = text_bytes(pa.array(["ab c", None, "é"]))
    got, owner = subwords(data, offsets)
    want = []
    for t, text in enumerate([b"ab c", b"", "é".encode()]):
        for n in (2, 3, 4):
            for k in range(len(text) - n + 1):
                w = text[k:k + n]
                if b" " not in w[1:-1] and w != b"  ":
                    want.append((t, int(mix(np.array([int.from_bytes(bytes([n]) + w, "big")], np.uint64))[0] >> np.uint64(50))))
    assert sorted(zip(owner.tolist(), got.tolist(), strict=True)) == sorted(want)


def test_held_out_accuracy_and_calibration(spark):
    docs = corpus(spark)
    got = identify(docs, fit(docs)).join(docs.select("doc_id", "truth"), "doc_id").where("held_out").collect()
    assert len(got) > 50 and sum(r.lang_pred == r.truth for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.rejected for r in got]) < 0.2


def test_label_columns_do_not_matter(spark):
    docs = corpus(spark, 90)
    model = fit(docs)
    a = {(r.doc_id, r.lang_pred, r.score) for r in identify(docs, model).collect()}
    assert a == {(r.doc_id, r.lang_pred, r.score) for r in identify(docs.drop("lang").selectExpr("*", "'q' as lang"), model).collect()}


def test_edges(spark):
    docs = corpus(spark, 90)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 %% 4"), (3, "12 %% 4"), (None, "blorp zek"), (5, "lalie esou " * 40_000)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.lang_pred, r.rejected and r.score == 0) for r in identify(odd, fit(docs)).collect()))
    assert got == [(0, "xx", False), (1, "und", True), (2, "und", True), (3, "und", True), (3, "und", True), (5, "yy", False)]
    assert {r.lang_pred for r in identify(odd, fit(docs.limit(0))).collect()} == {"und"}
    assert identify(odd.limit(0), Model()).count() == 0


def test_ties_of_one_class():
    model = train([(np.array([1, 2]), np.array([0.5, 0.5], np.float32))] * 10, np.zeros(10, int), ["aa"])
    assert model.predict(pa.array(["abc"]))[0].tolist() == [0]
