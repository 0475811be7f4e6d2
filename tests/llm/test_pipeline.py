import sentencepiece
from test_decontaminate import brute as leaks
from test_jaccard_join import brute as classes

import corpus_pipeline
from etlvault.llm.common import read
from etlvault.llm.piece_transducer import MODEL_PATH
from etlvault.llm.toxicity import fit, score

SF_DIR = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    """Each stage's decisions, worked out anew from the rows that it was given."""
    given = {r.doc_id: r for r in read(spark, SF_DIR, "documents").collect()}
    docs, columns = read(spark, SF_DIR, "documents"), read(spark, SF_DIR, "documents").columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_DIR)
        assert out.columns == columns
        rows = out.collect()
        kept[name] = {r.doc_id for r in rows}
        assert all(given[r.doc_id] == r for r in rows) and len(rows) == len(kept[name])
        docs = spark.createDataFrame(rows, docs.schema)
    source = read(spark, SF_DIR, "documents")
    toxic = {r.doc_id for r in score(source, fit(source, read(spark, SF_DIR, "labels"))).where("predicted = 1").collect()}
    assert kept["toxicity"] == given.keys() - toxic and toxic

    first = {}
    for i in sorted(kept["toxicity"]):
        first.setdefault(" ".join(given[i].text.replace("\n", " ").split(" ")), i)
    assert kept["exact dedup"] == set(first.values())

    assert kept["n-gram Jaccard join"] == {i for i, c, _ in classes([(i, given[i].text) for i in sorted(kept["exact dedup"])]) if i == c}

    items = [(r.item_id, r.text) for r in read(spark, SF_DIR, "benchmark").collect()]
    leaked = {d for d, _ in leaks([(i, given[i].text) for i in kept["n-gram Jaccard join"]], items)}
    assert kept["benchmark decontamination"] == kept["n-gram Jaccard join"] - leaked and leaked

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL_PATH)
    final = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {r.doc_id: r.ids for r in final} == {i: library.encode(given[i].text) for i in kept["benchmark decontamination"]}
    assert all(r.lossless for r in final)


def test_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, paths string"
    rows = [(1, None, None, None, None, 1.0, "x"), (2, "", None, None, 0, None, None), (3, "a b", "en", "s", 3, None, None), (3, "a b", "en", "s", 3, None, None),
            (None, "c d", None, None, None, None, None), (5, "long " * 60_000, "en", "s", 300_000, None, None)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 1, 3, 5]
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
