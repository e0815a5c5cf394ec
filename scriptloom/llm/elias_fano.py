"""Elias-Fano sequences and packed integers over byte buffers, queried in bulk.

A sorted sequence of n values is kept as low bits (packed) and high bits (unary, about
two bits a value) with a small rank directory. Buffers may be memory-mapped; queries
read only what they touch.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_ONE, _SIX, _63 = U(1), U(6), U(63)


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Fixed-width packing into 64-bit words, with one spare word at the end."""
    values = values.astype(U)
    words = np.zeros(len(values) * width // 64 + 2, U)
    if width and len(values):
        at = np.arange(len(values), dtype=U) * U(width)
        word, shift = (at >> _SIX).astype(np.int64), at & _63
        np.bitwise_or.at(words, word, values << shift)
        over = (shift + U(width)) > U(64)
        np.bitwise_or.at(words, word[over] + 1, values[over] >> (U(64) - shift[over]))
    return words


def unpack(words: np.ndarray, width: int, index: np.ndarray) -> np.ndarray:
    if not width:
        return np.zeros(len(index), U)
    at = index.astype(U) * U(width)
    word, shift = (at >> _SIX).astype(np.int64), at & _63
    low = words[word] >> shift
    high = np.where(shift > 0, words[word + 1] << ((U(64) - shift) & _63), U(0))
    return (low | high) & (U((1 << width) - 1))


#: Fixed masks of byte-wise arithmetic, and the place of the k-th set bit of each byte.
_LOW7, _HIGH1, _EACH = U(0x7F7F7F7F7F7F7F7F), U(0x8080808080808080), U(0x0101010101010101)
_IN_BYTE = np.zeros(256 * 8, np.uint8)
for _byte in range(256):
    for _rank, _bit in enumerate(b for b in range(8) if _byte >> b & 1):
        _IN_BYTE[_byte * 8 + _rank] = _bit


def _select_in_word(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the rank-th (from 0) set bit of each word: byte sums by multiplication,
    the byte by comparing all sums at once, the bit by table."""
    rank = rank.astype(U)
    sums = np.bitwise_count(word.view(np.uint8)).view(U) * _EACH
    below = ((rank * _EACH | _HIGH1) - (sums & _LOW7)) & _HIGH1
    # a full word's last sum is 64, below 128, so the bytewise subtraction cannot borrow
    at = np.minimum(np.bitwise_count(below), 7).astype(U) << U(3)
    before = np.where(at > 0, sums >> ((at - U(8)) & _63), U(0)) & U(0xFF)
    byte = (word >> at) & U(0xFF)
    return at + _IN_BYTE[((byte << U(3)) + ((rank - before) & U(7))).astype(np.int64)].astype(U)


class EliasFano:
    """Header words: n, low width, words of low bits, words of high bits."""

    def __init__(self, words: np.ndarray):
        n, width, n_low, n_high = (int(x) for x in words[:4])
        self.n, self.width = n, width
        self.low = words[4 : 4 + n_low]
        self.high = words[4 + n_low : 4 + n_low + n_high]
        self.size = 4 + n_low + n_high + (n_high + 1)
        self.ones = words[4 + n_low + n_high : self.size].astype(np.int64)
        self.zeros = 64 * np.arange(n_high + 1, dtype=np.int64) - self.ones

    @staticmethod
    def build(values: np.ndarray) -> np.ndarray:
        """Words of a sorted sequence of unsigned values."""
        values = np.asarray(values, U)
        n = len(values)
        universe = int(values[-1]) + 1 if n else 1
        width = max(0, (universe // n).bit_length() - 1) if n else 0
        low = pack(values & U((1 << width) - 1), width)
        tops = (values >> U(width)).astype(np.int64) if width < 64 else np.zeros(n, np.int64)
        ones = tops + np.arange(n)
        bits = int(ones[-1]) + 2 if n else 1
        high = np.zeros(bits // 64 + 1, U)
        np.bitwise_or.at(high, ones >> 6, _ONE << (ones.astype(U) & _63))
        counts = np.concatenate(([0], np.cumsum(np.bitwise_count(high).astype(np.int64))))
        return np.concatenate([np.array([n, width, len(low), len(high)], U), low, high, counts.astype(U)])

    def _select1(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i, side="right") - 1
        return 64 * word + _select_in_word(self.high[word], i - self.ones[word]).astype(np.int64)

    def _select0(self, i: np.ndarray) -> np.ndarray:
        word = np.minimum(np.searchsorted(self.zeros, i, side="right") - 1, len(self.high) - 1)
        return 64 * word + _select_in_word(~self.high[word], i - self.zeros[word]).astype(np.int64)

    def _run(self, at: np.ndarray, top: np.ndarray) -> np.ndarray:
        """Ones from a place on; long runs by the next zero."""
        word, shift = np.minimum(at >> 6, len(self.high) - 1), (at & 63).astype(U)
        after = np.where(word + 1 < len(self.high), self.high[np.minimum(word + 1, len(self.high) - 1)], U(0))
        window = (self.high[word] >> shift) | np.where(shift > 0, after << ((U(64) - shift) & _63), U(0))
        run = np.bitwise_count(window & ~(window + _ONE)).astype(np.int64)
        if (long := run >= 63).any():
            run[long] = self._select0(top[long]) - at[long]
        return run

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at places (each below n)."""
        i = np.asarray(i, np.int64)
        return ((self._select1(i) - i).astype(U) << U(self.width)) | unpack(self.low, self.width, i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Place of the first value of at least x; n if there is none."""
        x = np.asarray(x, U)
        if not self.n:
            return np.zeros(len(x), np.int64)
        top = x >> U(self.width)
        last = U(64 * len(self.high) - int(self.ones[-1]) - 1)  # the last zero
        beyond = top > last
        top = np.minimum(top, last).astype(np.int64)
        at = np.where(top > 0, self._select0(np.maximum(top - 1, 0)) + 1, 0)
        start = at - top
        stop = np.minimum(start + self._run(at, top), self.n)
        low = x & U((1 << self.width) - 1)
        start = np.minimum(start, stop)
        a, b = start, stop.copy()
        while (open_ := a < b).any():
            mid = (a + b) >> 1
            less = np.zeros(len(x), bool)
            less[open_] = unpack(self.low, self.width, mid[open_]) < low[open_]
            a = np.where(open_ & less, mid + 1, a)
            b = np.where(open_ & ~less, mid, b)
        return np.where(beyond, self.n, a)
