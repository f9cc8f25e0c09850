"""Elias-Fano sequences in memory-mapped arrays: access and successor search on many values at once."""

from __future__ import annotations

import numpy as np

U64 = np.uint64


#: The position of the set bit number r (from 0) of byte b at 8 * b + r; 0 where the byte has no such bit.
_IN_BYTE = np.array([([k for k in range(8) if b >> k & 1] + [0] * 8)[r] for b in range(256) for r in range(8)], np.int64)
_EACH = U64(0x0101010101010101)


def _select_in_word(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Position of the set bit number ``rank`` (from 0) of each word: its byte by the bytes' running sums, then a table."""
    rank = rank.astype(U64)
    sums = words - ((words >> U64(1)) & (_EACH * U64(0x55)))
    sums = (sums & (_EACH * U64(0x33))) + ((sums >> U64(2)) & (_EACH * U64(0x33)))
    sums = ((sums + (sums >> U64(4))) & (_EACH * U64(0x0F))) * _EACH
    full = ((rank * _EACH | (_EACH << U64(7))) - sums) & (_EACH << U64(7))  # a mark for each byte up to whose end are at most ``rank`` bits
    shift = np.minimum(np.bitwise_count(full), 7).astype(U64) << U64(3)
    rank = (rank - ((sums << U64(8)) >> shift & U64(0xFF))) & U64(7)
    return shift.astype(np.int64) + _IN_BYTE[((words >> shift & U64(0xFF)) << U64(3) | rank).astype(np.int64)]


class EliasFano:
    """A non-decreasing sequence of integers below ``universe``. ``place`` puts each array where it should live."""

    def __init__(self, values: np.ndarray, universe: int, place=lambda x: x):
        n = self.n = len(values)
        self.bits = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
        values = values.astype(U64)
        upper = (values >> U64(self.bits)).astype(np.int64) + np.arange(n)
        size = (universe >> self.bits) + n + 2
        flags = np.zeros(-(-size // 64) * 64, np.uint8)
        flags[upper] = 1
        high = np.packbits(flags, bitorder="little").view(U64)
        low = np.zeros(-(-n * self.bits // 64) + 2, U64)
        if self.bits and n:
            bit = np.arange(n, dtype=np.int64) * self.bits
            word, shift = bit >> 6, (bit & 63).astype(U64)
            part = values & U64((1 << self.bits) - 1)
            np.bitwise_or.at(low, word, part << shift)
            over = (bit & 63) + self.bits > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (U64(64) - shift[over]))
        self._hold(low, high, place)

    def _hold(self, low: np.ndarray, high: np.ndarray, place) -> None:
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(high), dtype=np.int64)))[:-1]
        self.low, self.high, self.ones = place(low), place(high), place(ones)
        self.zeros = place(64 * np.arange(len(high), dtype=np.int64) - ones)

    def arrays(self) -> list[np.ndarray]:
        """All that the sequence has to keep; ranks come from them."""
        return [np.array([self.n, self.bits], np.int64), self.low, self.high]

    @classmethod
    def of_arrays(cls, sizes: np.ndarray, low: np.ndarray, high: np.ndarray, place=lambda x: x) -> EliasFano:
        out = cls.__new__(cls)
        out.n, out.bits = sizes.tolist()
        out._hold(low, high, place)
        return out

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), U64)
        bit = i * self.bits
        word, shift = bit >> 6, (bit & 63).astype(U64)
        above = np.where(shift > 0, self.low[word + 1] << ((U64(64) - shift) & U64(63)), U64(0))
        return ((self.low[word] >> shift) | above) & U64((1 << self.bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at the places ``i``."""
        word = np.searchsorted(self.ones, i, side="right") - 1
        upper = 64 * word + _select_in_word(self.high[word], i - self.ones[word]) - i
        return (upper.astype(U64) << U64(self.bits)) | self.lows(i)

    def _before(self, upper: np.ndarray) -> np.ndarray:
        """How many values have smaller upper bits."""
        k = np.maximum(upper - 1, 0)
        word = np.searchsorted(self.zeros, k, side="right") - 1
        at = 64 * word + _select_in_word(~self.high[word], k - self.zeros[word])
        return np.where(upper > 0, at - k, 0)

    def successor(self, x: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first value of at least x between start and stop, whether it is x)."""
        x = x.astype(U64)
        upper, want = (x >> U64(self.bits)).astype(np.int64), x & U64((1 << self.bits) - 1)
        lo = np.clip(self._before(upper), start, stop)
        end = np.clip(self._before(upper + 1), lo, stop)
        hi = end.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            low, high = lo[open_], hi[open_]
            mid = (low + high) >> 1
            less = self.lows(mid) < want[open_]
            lo[open_], hi[open_] = low, high = np.where(less, mid + 1, low), np.where(less, high, mid)
            open_ = open_[low < high]
        found = lo < end
        found[found] = self.lows(lo[found]) == want[found]
        return lo, found


def packed(values: np.ndarray, universe: int) -> bytes:
    """A non-decreasing sequence as bytes."""
    return joined(EliasFano(values, universe).arrays())


def unpacked(data: bytes) -> np.ndarray:
    """The sequence that ``packed`` wrote."""
    sequence = EliasFano.of_arrays(*parted(data))
    upper = np.flatnonzero(np.unpackbits(sequence.high.view(np.uint8), bitorder="little")) - np.arange(sequence.n)
    return (upper.astype(U64) << U64(sequence.bits)) | sequence.lows(np.arange(sequence.n))


def joined(arrays: list[np.ndarray]) -> bytes:
    """Arrays one after another, each after its type and length."""
    return b"".join(np.array([ord(x.dtype.char), x.nbytes], np.int64).tobytes() + x.tobytes() for x in arrays)


def parted(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        kind, size = np.frombuffer(data, np.int64, 2, at).tolist()
        dtype = np.dtype(chr(kind))
        out.append(np.frombuffer(data, dtype, size // dtype.itemsize, at + 16))
        at += 16 + size
    return out
