"""What several operators of this subpackage need: tables, hashing of words in numpy, groups of a sorted stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from etlvault.session import cut_lineage

cut = cut_lineage
SHINGLE_WORDS = 5

_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BLOCK_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def crc_mod(column: str, n: int):
    """crc32 of the id as text, modulo ``n``; NULL ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(n))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits (a bijection)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the n + 1 offsets into them; NULL counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the number of its text.

    A word is a run of ASCII letters, digits, underscores and characters beyond ASCII.
    """
    is_word = _WORD_BYTE[data]
    before = np.concatenate([[False], is_word[:-1]]) if len(data) else is_word
    after = np.concatenate([is_word[1:], [False]]) if len(data) else is_word
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    before[cuts] = False
    after[cuts - 1] = False
    start = np.flatnonzero(is_word & ~before)
    end = np.flatnonzero(is_word & ~after) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of every byte span; blocks of spans keep the scratch arrays small."""
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        stop = max(at + 1, int(np.searchsorted(end, start[at] + _BLOCK_BYTES, "right")))
        s, e = start[at:stop], end[at:stop]
        length = e - s
        first = np.concatenate([[0], np.cumsum(length)[:-1]])
        place = np.arange(int(length.sum())) - np.repeat(first, length)
        power = np.cumprod(np.full(int(length.max()), _BASE, np.uint64))
        values = (data[np.repeat(s, length) + place].astype(np.uint64) + np.uint64(1)) * power[place]
        out[at:stop] = mix(np.add.reduceat(values, first) + length.astype(np.uint64))
        at = stop
    return out


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every lower-case word of the texts in order, and the number of its text."""
    data, offsets = text_bytes(pc.utf8_lower(texts))
    start, end, owner = word_spans(data, offsets)
    return span_hashes(data, start, end), owner


def ngram_hashes(words: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n-gram that starts at each word, and whether it lies within one text."""
    total = np.zeros(len(words), np.uint64)
    whole = np.zeros(len(words), bool)
    last = len(words) - n + 1
    if last > 0:
        for k in range(n):
            total[:last] = (total[:last] + words[k:k + last]) * _BASE
        whole[:last] = owner[:last] == owner[n - 1:]
    return mix(total), whole


def shingle_sets(texts: pa.Array, n: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct word shingles of all texts, sorted per text, and n + 1 offsets per text.

    A text with some words but fewer than ``n`` has one shingle made of all of them;
    a text without words has none.
    """
    words, owner = word_hashes(texts)
    grams, whole = ngram_hashes(words, owner, n)
    counts = np.bincount(owner, minlength=len(texts))
    grams, owner_of = grams[whole], owner[whole]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        extra = []
        for t in short:
            total = counts[t:t + 1].astype(np.uint64)
            for w in words[first[t]:first[t] + counts[t]]:
                total = (total ^ w) * _BASE
            extra.append(total)
        grams = np.concatenate([grams, mix(np.concatenate(extra))])
        owner_of = np.concatenate([owner_of, short])
    order = np.lexsort((grams, owner_of))
    grams, owner_of = grams[order], owner_of[order]
    if len(grams):
        fresh = np.concatenate([[True], (grams[1:] != grams[:-1]) | (owner_of[1:] != owner_of[:-1])])
        grams, owner_of = grams[fresh], owner_of[fresh]
    return grams, np.searchsorted(owner_of, np.arange(len(texts) + 1))


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``limit`` bytes in a text column."""
    _, offsets = text_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that end at group ends, from batches of a partition sorted by a non-null ``key``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        change = np.flatnonzero(keys[1:] != keys[:-1])
        open_key = held and held[-1].column(key)[-1].as_py() == keys[0]
        if held and not open_key:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        if len(change):
            cut_at = int(change[-1]) + 1
            yield pa.Table.from_batches([*held, batch.slice(0, cut_at)]).combine_chunks()
            held = [batch.slice(cut_at)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str, copies: str, same: Column) -> DataFrame:
    """Rows of ``docs`` whose id is in ``kept``, where repeated rows of an id stay once.

    ``kept`` has one row per id with the number of its rows in ``copies``; the few ids held
    by several rows are made distinct by ``same``, all others take a semi join alone.
    """
    single = docs.join(kept.where(F.col(copies) == 1).select(id_col), id_col, "left_semi")
    several = docs.join(kept.where(F.col(copies) > 1).select(id_col), id_col, "left_semi")
    several = several.withColumn("__same", same).dropDuplicates([id_col, "__same"])
    return single.select(docs.columns).unionByName(several.select(docs.columns))
