"""Toxicity by a weighted lexicon, matched in one Aho-Corasick pass over the folded text.

Folding undoes disguises: compatibility forms, case, accents, look-alike letters of other
scripts, digits and signs that stand for letters. The lexicon is learned from labels: words
and word beginnings that toxic texts hold far more often than others, with log-odds weights.
Phrases in which such a word is harmless are exceptions, matched in the same pass, and cancel
the hits they cover. Hit weight is normalised by the text's length; a logistic curve turns it
into a score.

Defined cases: NULL, empty and wordless texts have no hits and score like any text without
hits; repeated rows score alike; a NULL id is never a training row; with fewer than two
classes to learn from, every score is 0; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from etlvault.llm.common import crc_mod, cut, read

# Bounds of the training sample and of what is learned from it.
SAMPLE_PER_CLASS = 4_000   # labelled rows of each class, the first ones by a hash of their id
LEXICON_SIZE = 3_000       # entries
CANDIDATES = 20_000        # entries looked at
EXCEPTIONS = 500           # learned exception phrases
MIN_SUPPORT = 3            # unlike toxic texts that hold an entry
MIN_LOG_ODDS = 2.0
STEM = (4, 8)              # characters of a word beginning

# Letters that look like a Latin letter, and characters written for a letter.
LOOKALIKES = dict(zip("аеорсухіјѕԁһӏкмтвнԛԝүαοεικνρτυχβηωγ", "aeopcyxijsdhlkmtbhqwyaoeiknptuxbnwy", strict=True))
DIGITS = dict(zip("01345789", "oleastbg", strict=True))
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "l", "+": "t"}

_TABLE = str.maketrans({**LOOKALIKES, **DIGITS, "ß": "ss", "ø": "o", "ł": "l", "đ": "d", "æ": "ae", "œ": "oe"})
_SIGN = re.compile("[" + re.escape("".join(SIGNS)) + "](?=\\w)")
_ACCENT = re.compile("[̀-ͯ]+")
_WORD = re.compile("[^\\W_]+")


def fold(text: str) -> str:
    """The words of a text without disguise, each between single spaces."""
    text = text.lower()
    if not text.isascii():
        text = _ACCENT.sub("", unicodedata.normalize("NFKD", text)).lower()
    if any(c in text for c in SIGNS):
        text = _SIGN.sub(lambda m: SIGNS[m.group()], text)
    return " " + " ".join(_WORD.findall(text.translate(_TABLE))) + " "


def entries_of(word: str) -> Iterator[str]:
    """Lexicon entries that match a word: the whole of it and its beginnings."""
    yield f" {word} "
    for n in range(STEM[0], min(STEM[1], len(word)) + 1):
        yield f" {word[:n]}"


class Matcher:
    """Weighted entries and exception phrases in one automaton.

    A word start scores once, with its heaviest entry.
    """

    def __init__(self, weights: dict[str, float], exceptions: Iterable[str] = ()):
        self.automaton = ahocorasick.Automaton()
        for entry, weight in weights.items():
            self.automaton.add_word(entry, (len(entry), weight))
        for phrase in exceptions:
            self.automaton.add_word(phrase, (len(phrase), None))
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def hits(self, folded: str) -> dict[int, float]:
        """Weight of each hit by the place of its word."""
        found: dict[int, float] = {}
        if self.empty:
            return found
        excused = []
        for last, (size, weight) in self.automaton.iter(folded):
            start = last - size + 1
            if weight is None:
                excused.append((start, last))
            elif weight > found.get(start, 0.0):
                found[start] = weight
        for a, b in excused:
            for start in [s for s in found if a <= s < b]:
                del found[start]
        return found

    def features(self, folded: str) -> tuple[float, float]:
        """Hit weight per hundred words, and hit weight on a log scale."""
        total = sum(self.hits(folded).values())
        words = max(1, folded.count(" ") - 1)
        return 100.0 * total / (words + 5), float(np.log1p(total))


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, float, float] = (0.0, 0.0, -50.0)  # of density, log weight, and the constant

    def scores(self, texts: Iterable[str | None], matcher: Matcher) -> np.ndarray:
        x = np.array([matcher.features(fold(t or "")) for t in texts], float).reshape(-1, 2)
        return logistic(x @ np.array(self.curve[:2]) + self.curve[2])


def logistic(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -50, 50)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Newton steps on a ridge-penalised logistic loss; the last coefficient is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.diag([1.0] * (x.shape[1] - 1) + [1e-6])
    for _ in range(steps):
        p = logistic(x @ w)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _count_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entry, cluster, toxic) of each text's distinct entries; alike texts share a cluster."""
    for batch in batches:
        rows: list[tuple[str, int, int]] = []
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            words = set(fold(text or "").split())
            cluster = min((_stable(w) for w in words), default=0)
            rows += [(e, cluster, toxic) for e in {e for w in words for e in entries_of(w)}]
        e, c, t = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(e, pa.string()), pa.array(c, pa.int64()), pa.array(t, pa.int32())], ["entry", "cluster", "toxic"])


def _stable(word: str) -> int:
    import xxhash
    return xxhash.xxh64_intdigest(word) >> 1


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, toxic, part) of a bounded sample of the labelled rows outside the held-out fold."""
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("__toxic"))
    known = known.groupBy("__id").agg(F.max("__toxic").alias("__toxic")).where(crc_mod("__id", 5) != 0)
    chosen = [known.where(F.col("__toxic") == c).orderBy(F.xxhash64("__id"), "__id").limit(per_class) for c in (0, 1)]
    # at most 2 x per_class pairs of an id and a label: a documented bound, so they may be broadcast
    rows = docs.join(F.broadcast(chosen[0].unionByName(chosen[1])), F.col(id_col) == F.col("__id"))
    return cut(rows.select(F.col(text_col).alias("text"), F.col("__toxic").alias("toxic"), F.pmod(F.xxhash64("__id"), F.lit(3)).cast("int").alias("part")))


def _lexicon(sample: DataFrame, totals: dict[int, int]) -> dict[str, float]:
    """Entries that toxic texts hold far more often, without those that a shorter one makes needless."""
    counts = (sample.mapInArrow(_count_entries, "entry string, cluster long, toxic int").distinct()
              .groupBy("entry").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
              .where(F.col("bad") >= MIN_SUPPORT))
    # both counts are taken one standard deviation to the cautious side
    odds = F.log((F.col("bad") - F.sqrt("bad")) / totals[1]) - F.log((F.col("good") + F.sqrt("good") + 1) / totals[0])
    best = (counts.withColumn("weight", odds).where(F.col("weight") >= MIN_LOG_ODDS)
            .orderBy(F.desc(F.col("weight") * F.col("bad")), F.length("entry"), "entry").limit(CANDIDATES).collect())
    weights: dict[str, float] = {}
    for r in best:
        stem = r.entry.strip()
        shorter = [weights.get(f" {stem[:n]}", 0.0) for n in range(STEM[0], len(stem) + (r.entry[-1] == " "))]
        if len(weights) < LEXICON_SIZE and max(shorter, default=0.0) < r.weight - 0.5:
            weights[r.entry] = float(r.weight)
    return weights


def _phrases(weights: dict[str, float]):
    """Per text: its features, and the two-word phrases around its hits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(weights)
        for batch in batches:
            rows = []
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                folded = fold(text or "")
                found = set()
                for start in matcher.hits(folded):
                    end = folded.index(" ", start + 1)
                    before, after = folded.rfind(" ", 0, start), folded.find(" ", end + 1)
                    found |= {folded[a:b + 1] for a, b in ((before, end), (start, after)) if a >= 0 and b >= 0}
                rows += [(p, toxic) for p in found]
            p, t = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.string()), pa.array(t, pa.int32())], ["phrase", "toxic"])
    return run


def fit(docs: DataFrame, labels: DataFrame, exceptions: Iterable[str] = (), id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn lexicon, exception phrases and score curve; ``exceptions`` are further harmless phrases."""
    sample = training_sample(docs, labels, id_col=id_col, text_col=text_col)
    totals = {0: 0, 1: 0} | {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals[0] or not totals[1]:
        return Model()
    weights = _lexicon(sample, totals)
    harmless = (sample.mapInArrow(_phrases(weights), "phrase string, toxic int").groupBy("phrase")
                .agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
                .where((F.col("good") >= MIN_SUPPORT) & (F.col("bad") * 4 <= F.col("good")))
                .orderBy(F.desc("good"), "phrase").limit(EXCEPTIONS).collect())
    excused = [r.phrase for r in harmless] + [fold(p) for p in exceptions]
    found = sample.select("toxic", _features(weights, excused)(F.col("text")).alias("x")).collect()  # two numbers per sampled row
    x = np.array([r.x for r in found], float).reshape(-1, 2)
    y = np.array([r.toxic for r in found], float)
    return Model(weights, excused, tuple(float(v) for v in fit_logistic(x, y)))


def _features(weights: dict[str, float], exceptions: list[str]):
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(weights, exceptions)
        for texts in parts:
            yield pd.Series([list(matcher.features(fold(t or ""))) for t in texts], dtype=object)
    return F.pandas_udf(run, "array<double>")


def score_column(spark: SparkSession, model: Model, text: Column) -> Column:
    """The score of a text column; the model is bounded by the sizes above and travels as a broadcast."""
    shared = spark.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        matcher = Matcher(own.weights, own.exceptions)
        for texts in parts:
            yield pd.Series(own.scores(texts, matcher))

    return F.pandas_udf(run, "double")(text)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    scored = docs.select(F.col(id_col).alias("doc_id"), score_column(docs.sparkSession, model, F.col(text_col)).alias("score"))
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows predicted toxic."""
    scored = docs.withColumn("__toxic_score", score_column(docs.sparkSession, model, F.col(text_col)))
    return scored.where("__toxic_score < 0.5").select(docs.columns)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, fit(docs, read(spark, sf_dir, "labels")))


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLE: dict[str, str] = {}
