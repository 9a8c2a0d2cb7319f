"""Counting quotient filters over fingerprints of up to 64 bits.

A fingerprint splits into a quotient (high bits: the home slot) and a remainder (the rest).
Remainders stand in order of their quotients, each run of one quotient sorted; a bit per
quotient says whether it has a run, a bit per slot whether a run ends there. Quotient and
remainder together give the fingerprint back, so filters merge without loss, also those of
different numbers of quotients.
"""

from __future__ import annotations

import numpy as np

_COUNTS = (np.uint8, np.uint16, np.uint32, np.uint64)


class QuotientFilter:
    def __init__(self, occupied: np.ndarray, run_end: np.ndarray, remainders: np.ndarray, counts: np.ndarray, remainder_bits: int):
        self.occupied, self.run_end, self.remainders, self.counts, self.remainder_bits = occupied, run_end, remainders, counts, remainder_bits

    @classmethod
    def of(cls, fingerprints: np.ndarray, counts: np.ndarray | None = None, total_bits: int = 64) -> QuotientFilter:
        """Filter of unsigned fingerprints below 2**total_bits; equal ones add up."""
        counts = np.ones(len(fingerprints), np.int64) if counts is None else counts
        order = np.argsort(fingerprints, kind="stable")
        fp, counts = fingerprints[order], counts[order]
        first = np.flatnonzero(np.r_[True, fp[1:] != fp[:-1]][: len(fp)])
        return cls.of_sorted(fp[first], np.add.reduceat(counts, first) if len(fp) else counts, total_bits)

    @classmethod
    def of_sorted(cls, fp: np.ndarray, counts: np.ndarray, total_bits: int) -> QuotientFilter:
        """Filter of ascending distinct fingerprints; as many quotients as fill half to all of the slots."""
        bits = total_bits - min(total_bits - 1, max(3, int(len(fp)).bit_length()))
        quotients = fp >> np.uint64(bits)
        occupied = np.zeros(1 << (total_bits - bits), bool)
        occupied[quotients.astype(np.int64)] = True
        run_end = np.r_[quotients[1:] != quotients[:-1], True][: len(fp)]
        return cls(occupied, run_end, fp & np.uint64((1 << bits) - 1), counts.astype(np.int64), bits)

    @property
    def total_bits(self) -> int:
        return self.remainder_bits + len(self.occupied).bit_length() - 1

    def fingerprints(self) -> np.ndarray:
        """The fingerprints, ascending; ``counts`` has the count of each."""
        runs = np.cumsum(np.r_[0, self.run_end[:-1]][: len(self.run_end)]).astype(np.int64)
        return np.flatnonzero(self.occupied).astype(np.uint64)[runs] << np.uint64(self.remainder_bits) | self.remainders

    def merge(self, other: QuotientFilter) -> QuotientFilter:
        """Merge of two sorted runs: each fingerprint of the smaller one is put at its place in the other."""
        big, small = (self, other) if len(self.counts) >= len(other.counts) else (other, self)
        a, b, counts = big.fingerprints(), small.fingerprints(), big.counts.copy()
        at = np.searchsorted(a, b)
        both = np.r_[a, np.uint64(0)][at] == b
        both &= at < len(a)
        counts[at[both]] += small.counts[both]
        new = ~both
        return QuotientFilter.of_sorted(np.insert(a, at[new], b[new]), np.insert(counts, at[new], small.counts[new]), self.total_bits)

    def packed(self) -> tuple[bytes, bytes, bytes, bytes]:
        """Occupied and run-end bits, remainders in as many bytes as they need, counts as narrow as they fit."""
        width = -(-self.remainder_bits // 8)
        remainders = np.ascontiguousarray(self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])
        kind = next(k for k in _COUNTS if self.counts.max(initial=0) <= np.iinfo(k).max)
        return np.packbits(self.occupied).tobytes(), np.packbits(self.run_end).tobytes(), remainders.tobytes(), self.counts.astype(np.dtype(kind).newbyteorder("<")).tobytes()

    @classmethod
    def unpacked(cls, occupied: bytes, run_end: bytes, remainders: bytes, counts: bytes, remainder_bits: int) -> QuotientFilter:
        narrow = np.frombuffer(remainders, np.uint8).reshape(-1, -(-remainder_bits // 8))
        wide = np.zeros((len(narrow), 8), np.uint8)
        wide[:, : narrow.shape[1]] = narrow
        size = len(counts) // max(1, len(narrow)) or 1
        ends = np.unpackbits(np.frombuffer(run_end, np.uint8))[: len(narrow)].astype(bool)
        return cls(np.unpackbits(np.frombuffer(occupied, np.uint8)).astype(bool), ends, wide.view("<u8").ravel(), np.frombuffer(counts, f"<u{size}").astype(np.int64), remainder_bits)
