"""Benchmark decontamination: word n-grams find passages, Smith-Waterman alignment scores them.

Every item offers all its word n-grams as seeds, however often documents or other items hold
them. The item is aligned with the words around each place a seed was found, as far as an
alignment through it may reach, and alignments whose score reaches a share of the item's perfect
score are reported. Items and places are passed over only where the words both sides have leave
no alignment of that score, so shared seeds cost little where they are all that is shared.

Items are worked through in blocks of bounded size, each of which is sent to all tasks; the
documents are neither joined nor shuffled.

Defined cases: NULL, empty and wordless texts and items match nothing; an item shorter than the
n-gram is one seed of its own length; items with the same words are aligned once and reported
each; repeated rows and NULL ids are reported like any other row; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from etlvault.llm.common import ngram_hashes, read, slices, word_hashes

SEED_WORDS = 5
THRESHOLD = 0.5          # share of the perfect alignment score from which a passage counts as leaked
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_WORDS = 1_000_000  # words of benchmark items that are sent to the tasks at once
SLACK = 8                # words by which the aligned window is wider than the item, at least


@dataclass
class Block:
    """Items of a block as word hashes, and their seeds: seed -> items, item -> (seed number, place)."""

    names: list[list[int]]
    words: list[np.ndarray]
    sizes: list[int]        # the lengths of seeds, one unless some items are very short
    seeds: dict[int, np.ndarray]    # length -> sorted seeds
    starts: dict[int, np.ndarray]   # where each seed's items begin
    item: dict[int, np.ndarray]
    own: dict[int, tuple[np.ndarray, np.ndarray]]  # item -> numbers of its seeds, sorted, and their places
    flat: np.ndarray        # the words of all items
    bounds: np.ndarray      # where each item's words begin


def make_block(items: list[tuple[int, str | None]]) -> Block:
    """Hash the items; items with equal words share one entry."""
    hashes, owner = word_hashes(pa.array([t for _, t in items], pa.string()))
    bounds = np.searchsorted(owner, np.arange(len(items) + 1))
    by_words: dict[bytes, int] = {}
    names, words = [], []
    for k, (name, _) in enumerate(items):
        own = hashes[bounds[k]:bounds[k + 1]]
        if len(own):
            at = by_words.setdefault(own.tobytes(), len(words))
            if at == len(words):
                words.append(own)
                names.append([])
            names[at].append(name)
    rows: dict[int, list[tuple[np.ndarray, int]]] = {}
    for k, own in enumerate(words):
        n = min(SEED_WORDS, len(own))
        grams, whole = ngram_hashes(own, np.zeros(len(own), int), n)
        rows.setdefault(n, []).append((grams[whole], k))
    flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
    block = Block(names, words, sorted(rows), {}, {}, {}, {}, flat, np.cumsum([0, *map(len, words)]))
    for n, parts in rows.items():
        block.seeds[n], numbers = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
        at = 0
        for grams, k in parts:
            own = numbers[at:at + len(grams)]
            at += len(grams)
            place = np.argsort(own, kind="stable")
            block.own[k] = own[place], place
        item = np.concatenate([np.full(len(g), k) for g, k in parts])
        order = np.argsort(numbers, kind="stable")
        block.item[n] = item[order]
        block.starts[n] = np.append(np.flatnonzero(np.diff(numbers[order], prepend=-1)), len(order))
    return block


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges that begin at ``first`` and have ``size`` members."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


def found_seeds(block: Block, n: int, texts: pa.Array, words: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in ``words``) where a seed of length ``n`` begins, and the seeds' numbers."""
    grams, whole = ngram_hashes(words, owner, n)
    seeds = block.seeds[n]
    screen = np.zeros(1 << 16, bool)
    screen[(seeds & np.uint64(0xFFFF)).astype(np.int64)] = True
    at = np.flatnonzero(whole & screen[(grams & np.uint64(0xFFFF)).astype(np.int64)])
    number = np.searchsorted(seeds, grams[at])
    number[number == len(seeds)] = 0
    hit = seeds[number] == grams[at]
    return at[hit], number[hit]


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment (Smith-Waterman, linear gaps): score, and the words of the window it covers.

    A row of the matrix is one numpy step: gaps along the row are a running maximum.
    """
    width = len(window)
    ramp = np.arange(width + 1) * -GAP
    above, begin = np.zeros(width + 1, np.int64), np.arange(width + 1)
    best = (0, 0, 0)
    for word in item:
        step = np.where(window == word, MATCH, MISMATCH)
        diagonal, up = above[:-1] + step, above[1:] + GAP
        take_diagonal = diagonal >= up
        row = np.concatenate([[0], np.where(take_diagonal, diagonal, up)])
        start = np.concatenate([[0], np.where(take_diagonal, begin[:-1], begin[1:])])
        fresh = row <= 0
        row[fresh], start[fresh] = 0, np.arange(width + 1)[fresh]
        raised = row + ramp
        top = np.maximum.accumulate(raised)
        source = np.maximum.accumulate(np.where(raised == top, np.arange(width + 1), 0))
        row, start = top - ramp, start[source]
        at = int(row.argmax())
        if row[at] > best[0]:
            best = (int(row[at]), int(start[at]), at)
        above, begin = row, start
    return best


def candidates(block: Block, n: int, numbers: np.ndarray, words: np.ndarray, threshold: float) -> np.ndarray:
    """Items that have one of the seeds and enough of a text's words to reach the threshold."""
    numbers = np.unique(numbers)
    items = np.unique(block.item[n][_ranges(block.starts[n][numbers], block.starts[n][numbers + 1] - block.starts[n][numbers])])
    size = block.bounds[items + 1] - block.bounds[items]
    held = np.isin(block.flat[_ranges(block.bounds[items], size)], words)
    return items[np.add.reduceat(held.astype(np.int64), np.cumsum(size) - size) / size >= threshold]


def most(present: np.ndarray) -> int:
    """No alignment scores more: the best run of words, of which the other side lacks those not ``present``.

    A word inside an alignment that the other side lacks is a mismatch or a gap.
    """
    total = np.concatenate([[0], np.cumsum(np.where(present, MATCH, max(MISMATCH, GAP)))])
    return int((total - np.minimum.accumulate(total)).max())


def leaks(block: Block, texts: pa.Array, threshold: float) -> Iterator[tuple[int, int, float, int, int]]:
    """(text, item, score, first word, end word) of the alignments that reach the threshold, best per text and item."""
    words, owner = word_hashes(texts)
    first_word = np.searchsorted(owner, np.arange(len(texts) + 1))
    seen: dict[tuple[int, bytes], tuple[int, int, int]] = {}
    for n in block.sizes:
        at, number = found_seeds(block, n, texts, words, owner)
        edges = np.append(np.flatnonzero(np.diff(owner[at], prepend=-1)), len(at))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            t = int(owner[at[a]])
            begin, end = int(first_word[t]), int(first_word[t + 1])
            for k in candidates(block, n, number[a:b], words[begin:end], threshold).tolist():
                own, (numbers, places) = block.words[k], block.own[k]
                first = np.searchsorted(numbers, number[a:b])
                times = np.searchsorted(numbers, number[a:b], "right") - first
                shift = np.sort(np.repeat(at[a:b], times) - places[_ranges(first, times)])  # where the item would begin
                groups = np.append(np.flatnonzero(np.diff(shift, prepend=shift[0] - len(own)) > len(own) // 2), len(shift))
                # so many words may an alignment of that score leave out
                margin = max(SLACK, int(MATCH * len(own) * (1 - threshold) / -GAP) + 1)
                best = (0.0, 0, 0)
                for x, y in zip(groups[:-1], groups[1:], strict=True):
                    lo, hi = max(begin, int(shift[x]) - margin), min(end, int(shift[y - 1]) + len(own) + margin)
                    window = words[lo:hi]
                    key = (k, window.tobytes())
                    if key not in seen:
                        bound = min(most(np.isin(own, window)), most(np.isin(window, own))) / (MATCH * len(own))
                        seen[key] = align(own, window) if bound >= threshold else (0, 0, 0)
                    points, start, stop = seen[key]
                    share = points / (MATCH * len(own))
                    if share >= threshold and share > best[0]:
                        best = (share, lo + start - begin, lo + stop - begin)
                if best[0]:
                    yield t, k, *best


def blocks_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", words: int = BLOCK_WORDS) -> Iterator[Block]:
    """The benchmark in blocks of about ``words`` words; only one block at a time is on the driver."""
    items = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.size(F.split(F.coalesce(F.col(text_col), F.lit("")), "\\s+")).alias("n"))
    total = items.agg(F.sum("n")).head()[0] or 0
    parts = -(-int(total) // words)
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part).select("id", "text").collect()
        block = make_block(sorted(((r.id, r.text) for r in rows), key=str))
        if block.words:
            yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word) of every leaked passage, the best of each document and item."""
    schema = "doc_id long, item_id long, score double, first_word int, end_word int"
    found = None
    for block in blocks_of(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                for part in slices(batch, "text"):
                    ids = part.column("id").to_pylist()
                    rows = [(ids[t], name, score, x, y) for t, k, score, x, y in leaks(own, part.column("text"), threshold) for name in own.names[k]]
                    columns = zip(*rows, strict=True) if rows else [()] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()), strict=True)],
                                                     ["doc_id", "item_id", "score", "first_word", "end_word"])

        part = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def _is_clean(shared, threshold: float):
    def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for texts in parts:
            column = pa.array(texts, pa.string(), from_pandas=True)
            good = np.ones(len(texts), bool)
            at = 0
            for part in slices(pa.RecordBatch.from_arrays([column], ["text"]), "text"):
                good[[at + t for t, *_ in leaks(own, part.column("text"), threshold)]] = False
                at += part.num_rows
            yield pd.Series(good)

    return F.pandas_udf(clean, "boolean")


def drop_leaked(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that hold a leaked passage."""
    out = docs
    for block in blocks_of(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        out = out.where(_is_clean(shared, threshold)(F.col(text_col)))
    return out


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {"op1_decontamination": op1_decontamination}
ORACLE: dict[str, str] = {}
