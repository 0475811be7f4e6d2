"""A counting quotient filter in numpy: a fingerprint is split into a quotient and a remainder."""

from __future__ import annotations

import numpy as np


class CountingQuotientFilter:
    """Fingerprints with counts, held as runs of sorted remainders.

    ``occupied`` has a bit per quotient, ``run_end`` a bit per remainder (the last of its
    run), so the i-th set bit of one belongs to the i-th of the other. Remainders of a run
    ascend and a count stands beside each, which makes the filter a sorted list: two of them
    merge without loss by merging their lists, and equal entries add their counts.
    """

    def __init__(self, fingerprints: np.ndarray, counts: np.ndarray, quotient_bits: int):
        """``fingerprints`` ascend and are distinct."""
        self.quotient_bits = quotient_bits
        shift = np.uint64(64 - quotient_bits)
        quotients = (fingerprints >> shift).astype(np.int64)
        occupied = np.zeros(1 << quotient_bits, bool)
        occupied[quotients] = True
        self.occupied = np.packbits(occupied)
        self.run_end = np.packbits(np.append(quotients[1:] != quotients[:-1], True)[:len(quotients)])
        self.remainders = fingerprints & ((np.uint64(1) << shift) - np.uint64(1))
        self.counts = counts.astype(np.int64)

    @classmethod
    def of(cls, fingerprints: np.ndarray, quotient_bits: int | None = None) -> CountingQuotientFilter:
        """The filter of unsorted fingerprints, with about one quotient for each."""
        values, counts = np.unique(fingerprints.astype(np.uint64), return_counts=True)
        return cls(values, counts, quotient_bits or max(3, int(len(values)).bit_length()))

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """All fingerprints, ascending, and their counts."""
        quotients = np.flatnonzero(np.unpackbits(self.occupied)).astype(np.uint64)
        ends = np.unpackbits(self.run_end)[:len(self.remainders)]
        run = np.cumsum(ends) - ends
        return (quotients[run] << np.uint64(64 - self.quotient_bits)) | self.remainders, self.counts

    def count(self, fingerprint: int) -> int:
        values, counts = self.entries()
        at = np.searchsorted(values, np.uint64(fingerprint))
        return int(counts[at]) if at < len(values) and values[at] == np.uint64(fingerprint) else 0

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        (a, m), (b, n) = self.entries(), other.entries()
        values, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        totals = np.bincount(place, np.concatenate([m, n]), len(values))
        return CountingQuotientFilter(values, totals, max(self.quotient_bits, other.quotient_bits, int(len(values)).bit_length()))

    def to_bytes(self) -> bytes:
        head = np.array([self.quotient_bits, len(self.remainders)], np.int64)
        return b"".join(x.tobytes() for x in (head, self.occupied, self.run_end, self.remainders, self.counts))

    @classmethod
    def from_bytes(cls, raw: bytes) -> CountingQuotientFilter:
        self = cls.__new__(cls)
        bits, n = (int(x) for x in np.frombuffer(raw, np.int64, 2))
        at = 16
        self.quotient_bits = bits
        for name, kind, size in (("occupied", np.uint8, 1 << bits >> 3), ("run_end", np.uint8, -(-n // 8)), ("remainders", np.uint64, n), ("counts", np.int64, n)):
            setattr(self, name, np.frombuffer(raw, kind, size, at))
            at += size * np.dtype(kind).itemsize
        return self
