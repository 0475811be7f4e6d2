"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The model is compiled once: the normaliser maps characters, the lexicon is a trie of pieces
whose arcs carry costs, and byte fallback gives every character outside the pieces a path of
its own. A text is composed with these lazily and the cheapest path in the tropical semiring
(costs add along a path, the least wins) is its encoding.

A unigram model weighs a piece by its negative log probability. A merge (BPE) model is the
same lexicon composed with an acceptor of neighbours: two pieces may follow each other only if
merging their joint text gives just these two. Merges inside one piece never depend on text
behind a boundary that no merge crosses, so exactly one path is accepted: the merge result.

Boundaries that no piece spans cut a text into independent segments, whose encodings are kept
in a table of bounded size, as most segments recur.

Defined cases: NULL text gives NULL ids and 0 pieces; empty text gives no ids; a text of any
length is encoded whole; decoding gives back the normalised text.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from etlvault.llm.common import read, slices

MODEL_PATH = os.environ.get("ETLVAULT_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
MODEL_LIMIT = 64 << 20   # bytes of a model file that is sent to all executors
KEPT_SEGMENTS = 400_000  # encodings a Python worker remembers; others are computed again
SPACE = "▁"
# Fixed values of the model file format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, MERGES = 1, 2
UNKNOWN_TEXT = " ⁇ "
UNKNOWN_PENALTY = 10.0


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            size = varint()
        yield key >> 3, raw[at:at + size]
        at += size


class PieceTransducer:
    """The compiled model. ``pieces`` are (text, cost score, kind) in id order."""

    def __init__(self, pieces: list[tuple[str, float, int]], model_type: int = MERGES, dummy_prefix: bool = True, squeeze_spaces: bool = False):
        if any(kind in (USER_DEFINED, UNUSED) for _, _, kind in pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.pieces, self.model_type = pieces, model_type
        self.dummy_prefix, self.squeeze_spaces = dummy_prefix, squeeze_spaces
        self.ids = {t: i for i, (t, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.score = {t: pieces[i][1] for t, i in self.ids.items()}
        self.byte_ids = {int(t[3:5], 16): i for i, (t, _, kind) in enumerate(pieces) if kind == BYTE}
        self.unknown_id = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        self.pairs = {t[k:k + 2] for t in self.ids for k in range(len(t) - 1)}
        self._beside: dict[str, dict[str, bool]] = {}
        self._trie = self._lexicon()
        self._fallback_cost = UNKNOWN_PENALTY + (-min(self.score.values(), default=0.0) if model_type == UNIGRAM else 0.0)
        self._segment_bytes = _Kept(self)
        fine, coarse = re.compile(f"{SPACE}*\\w+|{SPACE}*[^\\w{SPACE}]+|{SPACE}+"), re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self._coarse = coarse if all(len(coarse.findall(p)) == 1 for p in self.pairs) else None
        self._fine = fine
        self._spanned = [p for p in self.pairs if len(fine.findall(p)) > 1]  # pairs of characters that the finer cut would part
        self._table = pa.array([SPACE.join(t.split(SPACE)).replace(SPACE, " ").encode() if kind == NORMAL else bytes([int(t[3:5], 16)]) if kind == BYTE
                                else UNKNOWN_TEXT.encode() if kind == UNKNOWN else b"" for t, _, kind in pieces], pa.large_binary())

    @classmethod
    def from_model(cls, raw: bytes) -> PieceTransducer:
        """Compile a serialised SentencePiece model."""
        pieces, model_type, prefix, squeeze = [], UNIGRAM, True, True
        for number, value in _fields(raw):
            if number == 1:
                text, score, kind = "", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        text = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                pieces.append((text, score, kind))
            elif number == 2:
                model_type = next((v for n, v in _fields(value) if n == 3), UNIGRAM)
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(2):
                    raise ValueError("models with a compiled character map are not supported")
                prefix, squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if model_type not in (UNIGRAM, MERGES):
            raise ValueError("neither a unigram nor a merge model")
        return cls(pieces, model_type, prefix, squeeze)

    def normalise(self, text: str) -> str:
        if self.squeeze_spaces:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        return (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)

    def segments(self, normalised: str) -> list[str]:
        """The text cut at boundaries that no piece spans."""
        if not any(p in normalised for p in self._spanned):
            return self._fine.findall(normalised)
        return self._coarse.findall(normalised) if self._coarse else [normalised]

    def _merged(self, text: str) -> list[str]:
        """Merge neighbours while any two form a piece: the best score first, leftmost of equals."""
        symbols, score = list(text), self.score
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _arc_cost(self, piece: str) -> float:
        return -self.score[piece] if self.model_type == UNIGRAM else 1.0

    def _lexicon(self) -> dict:
        """Trie of the pieces that a path may use: characters lead on, the empty key holds (piece, cost).

        A merge model uses only pieces that merging their own text gives.
        """
        root: dict = {}
        for piece in self.ids:
            if self.model_type == UNIGRAM or self._merged(piece) == [piece]:
                node = root
                for c in piece:
                    node = node.setdefault(c, {})
                node[""] = (piece, self._arc_cost(piece))
        return root

    def _may_follow(self, left: str, right: str) -> bool:
        """The acceptor's arc from one piece to the next, remembered in ``_beside``."""
        known = self.model_type == UNIGRAM or left[-1] + right[0] not in self.pairs or self._merged(left + right) == [left, right]
        if len(self._beside) > KEPT_SEGMENTS:
            self._beside.clear()
        self._beside.setdefault(left, {})[right] = known
        return known

    def shortest_path(self, text: str) -> list[str]:
        """Pieces of the cheapest accepted path over a segment; a state is an end position and its last piece."""
        if len(text) == 1:
            return [text]
        beside, nothing, length = self._beside, {}, len(text)
        # per position: last piece -> (cost, start, piece before)
        states: list[dict[str, tuple[float, int, str]]] = [{} for _ in range(length + 1)]
        states[0][""] = (0.0, 0, "")
        for at in range(length):
            here = states[at]
            if not here:
                continue
            arcs, node = [], self._trie
            for end in range(at, length):
                node = node.get(text[end])
                if node is None:
                    break
                if "" in node:
                    arcs.append(node[""])
            if text[at] not in self.score:  # the fallback arc
                arcs.append((text[at], self._fallback_cost))
            for piece, cost in arcs:
                best = None
                for before, state in here.items():
                    if best is None or state[0] < best[0]:
                        fits = True if not before else beside.get(before, nothing).get(piece)
                        if fits or fits is None and self._may_follow(before, piece):
                            best = (state[0], before)
                if best is not None:
                    states[at + len(piece)][piece] = (best[0] + cost, at, best[1])
        at, out = length, []
        piece = min(states[at], key=lambda p: states[at][p][0])
        while piece:
            out.append(piece)
            _, start, before = states[at][piece]
            at, piece = start, before
        return out[::-1]

    def segment_ids(self, text: str) -> list[int]:
        out = []
        for piece in self.shortest_path(text):
            if piece in self.ids:
                out.append(self.ids[piece])
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in piece.encode()]
            else:
                out.append(self.unknown_id)
        return out

    def encode_packed(self, text: str) -> bytes:
        """Ids of a text as packed 32-bit integers."""
        return b"".join(map(self._segment_bytes.__getitem__, self.segments(self.normalise(text))))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), np.int32).tolist()

    def decode_column(self, ids: pa.ListArray) -> pa.Array:
        """Texts of a column of ids: pieces are laid end to end and cut again by text."""
        values = ids.flatten()
        if len(values) and (pc.min(values).as_py() < 0 or pc.max(values).as_py() >= len(self.pieces)):
            raise ValueError("an id is not in the model")
        joined = self._table.take(values)
        ends = np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1, joined.offset * 8)
        raw = joined.buffers()[2] or pa.py_buffer(b"")
        lengths = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        bounds = ends[np.concatenate([[0], np.cumsum(lengths)])]
        if self.dummy_prefix or self.squeeze_spaces:
            data = np.frombuffer(raw, np.uint8)
            starts = bounds[:-1] + [bool(n) and data[b] == 32 for b, n in zip(bounds[:-1], lengths, strict=True)]
        else:
            starts = bounds[:-1]
        view = memoryview(raw)
        texts = [bytes(view[a:b]).decode("utf-8", "replace") for a, b in zip(starts, bounds[1:], strict=True)]
        return pa.array(texts, pa.string(), mask=np.asarray(pc.is_null(ids)))

    def decode(self, ids: list[int]) -> str:
        return self.decode_column(pa.array([ids], pa.list_(pa.int32())))[0].as_py()


class _Kept(dict):
    """Encodings of segments; the first ones seen stay, as frequent segments come early."""

    def __init__(self, owner: PieceTransducer):
        super().__init__()
        self.owner = owner

    def __missing__(self, segment: str) -> bytes:
        packed = np.array(self.owner.segment_ids(segment), np.int32).tobytes()
        if len(self) < KEPT_SEGMENTS:
            self[segment] = packed
        return packed


_COMPILED: dict[bytes, PieceTransducer] = {}  # lives as long as the Python worker


def compiled(raw: bytes) -> PieceTransducer:
    if raw not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[raw] = PieceTransducer.from_model(raw)
    return _COMPILED[raw]


def load_model(path: str = MODEL_PATH) -> bytes:
    if os.path.getsize(path) > MODEL_LIMIT:
        raise ValueError(f"{path} is larger than {MODEL_LIMIT} bytes")
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, n_ids, lossless): the encoded texts; ``lossless`` says that decoding gives the text back."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = compiled(shared.value)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                packed = [fst.encode_packed(t) if t else b"" for t in texts]
                lengths = np.array([len(p) // 4 for p in packed], np.int32)
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                missing = np.array([t is None for t in texts], bool)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32)), mask=pa.array(missing))
                back = fst.decode_column(ids).to_pylist()
                lossless = [t == b for t, b in zip(texts, back, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), ids, pa.array(lengths), pa.array(lossless)], ["doc_id", "ids", "n_ids", "lossless"])

    rows = docs.selectExpr(f"cast(`{id_col}` as long) as id", f"`{text_col}` as text")
    return rows.mapInArrow(run, "doc_id long, ids array<int>, n_ids int, lossless boolean")


def decode(encoded: DataFrame, model: bytes, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with the column ``decoded``: the text of each row's ids."""
    from pyspark.sql.functions import col, pandas_udf

    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def texts(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fst = compiled(shared.value)
        for ids in parts:
            yield fst.decode_column(pa.array(ids, pa.list_(pa.int32()), from_pandas=True)).to_pandas()

    return encoded.withColumn("decoded", pandas_udf(texts, "string")(col(f"`{ids_col}`")))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"), load_model())


QUERIES = {"op8_sentencepiece": op8_sentencepiece}
ORACLE: dict[str, str] = {}
