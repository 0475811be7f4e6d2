"""The corpus pipeline: each stage reads what the one before it kept.

Every stage writes its rows as Parquet in the shared folder and the next one reads them back, so
a lost executor costs at most the tasks it held.

Defined cases: rows without an id are kept by every filter that does not reject their text;
repeated rows of one id and text stay once after exact de-duplication; NULL and empty texts are
clean; an empty table gives an empty table. Further columns are carried along by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from etlvault.llm.common import read
from etlvault.llm.decontaminate import drop_leaked
from etlvault.llm.exact_dedup import drop_copies
from etlvault.llm.jaccard_join import drop_similar
from etlvault.llm.piece_transducer import encode, load_model
from etlvault.llm.toxicity import drop_toxic, fit
from etlvault.session import scratch_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the lexicon, learned from the labels, scores as toxic."""
    return drop_toxic(docs, fit(docs, read(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first of all documents with equal text."""
    return drop_copies(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first of all documents of a class of near copies."""
    return drop_similar(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a passage of a benchmark item."""
    return drop_leaked(docs, read(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document that is left."""
    return encode(docs, load_model())


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding and decoding", sentencepiece),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"corpus-{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
