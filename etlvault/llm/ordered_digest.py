"""SHA-256 of a group's pieces joined in order, where a group may hold a third of all rows.

The hash of one group is one stream by its nature, but no task gathers the group: pieces are
range-partitioned by group and order, each task joins its runs into chunks and hashes the groups
that lie within it; only groups that reach a task's first or last row, two for each task, or that
outgrow a chunk go on as chunks and are streamed once more. Memory is one chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CHUNK = 1 << 20  # bytes of joined pieces in a row, unless one piece is longer
_SCHEMA = pa.schema([("key", pa.string()), ("first", pa.int64()), ("chunk", pa.binary()), ("sha256", pa.string())])


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
    keys = batch.column("key")
    codes = keys.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield keys[a].as_py(), batch.slice(a, b - a)


def _joiner(separator: bytes) -> Callable:
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        waiting = 0                          # bytes in ``out``
        key, first, held, size = None, 0, [], 0
        shared = True                        # the open run may go on in another row

        def close(last: bool) -> None:
            """End the open run; one that starts and ends inside the partition is whole."""
            nonlocal waiting
            if key is None:
                return
            text = separator.join(held)
            if shared or last:
                out.append((key, first, text, None))
                waiting += len(text)
            else:
                out.append((key, first, None, hashlib.sha256(text).hexdigest()))

        for batch in batches:
            for name, run in _runs(batch) if batch.num_rows else ():
                if name != key:
                    close(False)
                    shared = key is None
                    key, first, held, size = name, run.column("place")[0].as_py(), [], 0
                for place, piece in zip(run.column("place").to_pylist(), run.column("piece").to_pylist(), strict=True):
                    if size + len(piece) > CHUNK and held:
                        shared = True
                        close(False)
                        first, held, size = place, [], 0
                    held.append(piece)
                    size += len(piece) + len(separator)
                if waiting > CHUNK or len(out) > 10_000:
                    yield _batch(out)
                    out, waiting = [], 0
        close(True)
        if out:
            yield _batch(out)
    return join


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)


def _streamer(separator: bytes) -> Callable:
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            out = []
            for name, chunk, whole in zip(*(batch.column(c) for c in ("key", "chunk", "sha256")), strict=True):
                if whole.is_valid:
                    out.append((name.as_py(), 0, None, whole.as_py()))
                    continue
                if name.as_py() != key:
                    if key is not None:
                        out.append((key, 0, None, sha.hexdigest()))
                    key, sha = name.as_py(), hashlib.sha256()
                else:
                    sha.update(separator)
                sha.update(chunk.as_buffer())
            if out:
                yield _batch(out)
        if key is not None:
            yield _batch([(key, 0, None, sha.hexdigest())])
    return stream


def ordered_digest(pieces: DataFrame, separator: bytes) -> DataFrame:
    """(key, sha256): the hash of each key's pieces in the order of ``place``, joined by ``separator``.

    ``pieces`` has key string, place long (unique within a key) and piece binary, none of them NULL.
    Both steps read one shuffle each, so that no two readings of a shuffle need to agree.
    """
    schema = "key string, first long, chunk binary, sha256 string"
    ranged = pieces.select("key", "place", "piece").repartitionByRange("key", "place").sortWithinPartitions("key", "place")
    dealt = ranged.mapInArrow(_joiner(separator), schema).repartition("key").sortWithinPartitions("key", "first")
    return dealt.mapInArrow(_streamer(separator), schema).select("key", "sha256")
