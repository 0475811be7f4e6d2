"""Language identification: averaged embeddings of hashed subwords under a linear softmax.

Subwords are the byte 2- to 4-grams of the lower-case text whose inside holds no separator.
Embeddings and softmax are trained together in numpy by stochastic gradient descent on a
bounded sample of labelled rows. As the softmax is linear in the mean embedding, prediction
adds up one number per subword and language. Temperature and the rejection threshold are set
on a part of the sample that training did not see.

Defined cases: NULL text and text without a letter give ``und`` with score 0 and rejected;
the class never depends on any column but the text; a NULL id counts as the empty id text;
without labelled rows to learn from, every text is ``und``; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from etlvault.llm.common import crc_mod, mix, read, slices, text_bytes

SAMPLE_PER_LANGUAGE = 500  # expected labelled rows of each language that training sees
MAX_LANGUAGES = 400        # the most frequent labels are learned
BUCKETS = 1 << 14
DIMENSIONS = 12
EPOCHS = 8
RATE = 0.5
SNIPPETS = 3               # short excerpts drawn from each training text, besides the whole
TARGET_PRECISION = 0.99
SIZES = (2, 3, 4)
UNKNOWN = "und"

_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[*range(97, 123), *range(128, 256)]] = False


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every subword of the texts and the number of its text, in order of size and place."""
    gap = _SEPARATOR[data]
    letters = np.where(gap, np.uint8(32), data).astype(np.uint64)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    buckets, owners = [], []
    for n in SIZES:
        last = len(data) - n + 1
        if last <= 0:
            continue
        value = np.full(last, n, np.uint64)
        for k in range(n):
            value = (value << np.uint64(8)) | letters[k:k + last]
        good = owner[:last] == owner[n - 1:]
        good &= ~(gap[:last] & gap[n - 1:])
        for k in range(1, n - 1):
            good &= ~gap[k:k + last]
        buckets.append((mix(value[good]) >> np.uint64(50)).astype(np.int32))
        owners.append(owner[:last][good])
    if not buckets:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    table: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 0), np.float32))  # subword -> logit per language
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    temperature: float = 1.0
    threshold: float = 0.0

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of the likeliest language (-1 without a letter) and its calibrated probability."""
        n = len(texts)
        lowered = pc.utf8_lower(texts.cast(pa.large_string()))
        has_letter = np.array(pc.fill_null(pc.match_substring_regex(lowered, r"\pL"), False).to_numpy(zero_copy_only=False), bool)
        best, score = np.full(n, -1), np.zeros(n)
        if not self.languages or not n:
            return best, score
        data, offsets = text_bytes(lowered)
        buckets, owner = subwords(data, offsets)
        counts = np.bincount(owner, minlength=n)
        logits = np.empty((n, len(self.languages)))
        for k in range(len(self.languages)):
            logits[:, k] = np.bincount(owner, self.table[buckets, k], n)
        p = softmax((logits / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature)
        best[has_letter] = p.argmax(1)[has_letter]
        score[has_letter] = p.max(1)[has_letter]
        return best, score


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, languages: list[str], seed: int = 7) -> Model:
    """SGD over bags (buckets, weights that add up to one), rate falling to zero; balanced by language."""
    rng = np.random.default_rng(seed)
    classes = len(languages)
    embedding = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights, bias = np.zeros((DIMENSIONS, classes), np.float32), np.zeros(classes, np.float32)
    held = rng.random(len(bags)) < 0.2
    fit, check = np.flatnonzero(~held), np.flatnonzero(held)
    share = 1.0 / np.maximum(np.bincount(labels[fit], minlength=classes), 1)
    share *= len(fit) / classes
    steps, done = EPOCHS * max(1, len(fit)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(fit):
            buckets, w = bags[i]
            mean = w @ embedding[buckets]
            error = softmax(mean @ weights + bias)
            error[labels[i]] -= 1
            rate = RATE * (1 - done / steps) * min(share[labels[i]], 5.0)
            into = weights @ error
            weights -= rate * np.outer(mean, error)
            bias -= 0.1 * rate * error
            embedding[buckets] -= (rate * len(buckets) ** 0.5) * np.outer(w, into)
            done += 1
    model = Model(languages, (embedding @ weights).astype(np.float32), bias.astype(float))
    calibrate(model, [bags[i] for i in (check if len(check) else fit)], labels[check if len(check) else fit])
    return model


def calibrate(model: Model, bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> None:
    """Temperature of least log loss, then the lowest threshold above which enough predictions are right."""
    if not bags:
        return
    logits = np.array([w @ model.table[b] for b, w in bags]) + model.bias
    at = np.arange(len(labels))
    grid = np.geomspace(0.25, 5, 40)
    model.temperature = float(min(grid, key=lambda t: -np.log(softmax(logits / t)[at, labels] + 1e-9).sum()))
    p = softmax(logits / model.temperature)
    order = np.argsort(-p.max(1), kind="stable")
    right = (p.argmax(1) == labels)[order]
    good = np.flatnonzero(np.cumsum(right) / (at + 1) >= TARGET_PRECISION)
    model.threshold = float(p.max(1)[order][good[-1]]) if len(good) else 1.0


def training_rows(docs: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[DataFrame, list[str]]:
    """(text, label) of the sample, and the languages; rows are chosen by a hash of their id."""
    known = docs.where((crc_mod(id_col, 4) != 2) & F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    counts = known.groupBy(F.col(label_col).alias("label")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(MAX_LANGUAGES).collect()
    languages = sorted(r.label for r in counts)
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit("langid")), F.lit(1_000_000)) / 1_000_000
    if not counts:
        return known.limit(0).select(F.col(text_col).alias("text"), F.col(label_col).alias("label")), []
    shares = F.create_map(*[F.lit(x) for r in counts for x in (r.label, SAMPLE_PER_LANGUAGE / r.n)])
    return known.where(draw < shares[F.col(label_col)]).select(F.col(text_col).alias("text"), F.col(label_col).alias("label")), languages


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per sampled text its bag of subwords and those of some excerpts: (label, buckets, counts)."""
    for batch in batches:
        for part in slices(batch, "text"):
            labels, out = part.column("label").to_pylist(), []
            data, offsets = text_bytes(pc.utf8_lower(part.column("text").cast(pa.large_string())))
            for i, label in enumerate(labels):
                a, b = int(offsets[i]), int(offsets[i + 1])
                rng = np.random.default_rng(b - a)
                pieces = [(a, b)] + [(s, min(b, s + 60)) for s in rng.integers(a, max(a + 1, b - 30), SNIPPETS)]
                for x, y in pieces:
                    buckets, _ = subwords(data[x:y], np.array([0, y - x]))
                    if len(buckets):
                        out.append((label, *np.unique(buckets, return_counts=True)))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.list_(pa.int32())),
                                              pa.array([o[2].astype(np.int32) for o in out], pa.list_(pa.int32()))], ["label", "buckets", "counts"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Model:
    """Train on the bounded sample; its bags hold at most ``BUCKETS`` numbers each, so they fit the driver."""
    sample, languages = training_rows(docs, id_col, text_col, label_col)
    table = sample.mapInArrow(_bags, "label string, buckets array<int>, counts array<int>").toArrow()
    if not table.num_rows:
        return Model()
    number = {language: i for i, language in enumerate(languages)}
    labels = np.array([number[x] for x in table.column("label").to_pylist()])
    bags = []
    for b, c in zip(table.column("buckets"), table.column("counts"), strict=True):
        counts = c.values.to_numpy().astype(np.float32)
        bags.append((b.values.to_numpy(), counts / counts.sum()))
    order = np.lexsort(([hash((len(b), int(b[0]), int(b[-1]))) for b, _ in bags], labels))  # a fixed order, whatever task came first
    return train([bags[i] for i in order], labels[order], languages)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every row. The model travels as a broadcast of
    at most BUCKETS x MAX_LANGUAGES numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        names = np.array([*own.languages, UNKNOWN], object)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                best, score = own.predict(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(names[best], pa.string()), pa.array(score), pa.array((score < own.threshold) | (best < 0))],
                                                 ["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
    return found.select("doc_id", held_out("doc_id"), "lang_pred", "score", "rejected")


def held_out(id_col: str) -> Column:
    return (crc_mod(id_col, 4) == 2).alias("held_out")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return identify(docs, fit(docs))


QUERIES = {"op2_language_id": op2_language_id}
ORACLE: dict[str, str] = {}
