"""Elias-Fano sequences of rising 64-bit numbers, with vectorised access and successor search.

The low bits of each number are packed; the high parts are unary in a bitmap. A directory holds the
ones before each 256 bits, so that the place of the i-th one, and of the h-th zero, is a binary
search in the directory and a few steps within a line. All arrays may lie in a mapped file.
"""

from __future__ import annotations

import struct

import numpy as np

HEAD = "<QQII"  # numbers, bits of the bitmap, low bits, 0
LINE = 4  # words of 64 bits
U = np.uint64


def select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th (from 0) one bit of each word."""
    place = np.zeros(len(word), np.int64)
    k = k.copy()
    for width in (32, 16, 8, 4, 2, 1):
        low = word & U((1 << width) - 1)
        ones = np.bitwise_count(low).astype(np.int64)
        up = k >= ones
        k[up] -= ones[up]
        place[up] += width
        word = np.where(up, word >> U(width), low)
    return place


class EliasFano:
    def __init__(self, n: int, size: int, low_bits: int, high: np.ndarray, before: np.ndarray, low: np.ndarray):
        self.n, self.size, self.low_bits = n, size, low_bits
        self.high, self.before, self.low = high, before, low
        self.zeros = np.arange(len(before), dtype=np.int64) * (64 * LINE) - before.astype(np.int64)

    @staticmethod
    def to_bytes(values: np.ndarray) -> bytes:
        """Encode non-falling values (unsigned 64-bit)."""
        values = np.asarray(values, dtype=U)
        n = len(values)
        low_bits = max(0, int(values[-1] // U(n)).bit_length() - 1) if n else 0
        top = values >> U(low_bits)
        places = top.astype(np.int64) + np.arange(n)
        size = int(places[-1]) + 2 if n else 1
        lines = -(-size // (64 * LINE))
        bits = np.zeros(lines * 64 * LINE, np.uint8)
        bits[places] = 1
        high = np.packbits(bits, bitorder="little").view("<u8")
        count = np.bitwise_count(high).astype(np.int64).reshape(lines, LINE).sum(axis=1)
        before = np.concatenate([[0], np.cumsum(count)]).astype("<u8")
        low = np.zeros(n * low_bits // 64 + 2, "<u8")
        if low_bits and n:
            rest = values & U((1 << low_bits) - 1)
            at = np.arange(n, dtype=np.int64) * low_bits
            shift = (at & 63).astype(U)
            np.bitwise_or.at(low, at >> 6, rest << shift)
            over = np.flatnonzero((at & 63) + low_bits > 64)
            np.bitwise_or.at(low, (at[over] >> 6) + 1, rest[over] >> (U(64) - shift[over]))
        return struct.pack(HEAD, n, size, low_bits, 0) + before.tobytes() + high.tobytes() + low.tobytes()

    @classmethod
    def read(cls, data: np.ndarray, at: int) -> tuple[EliasFano, int]:
        """(sequence, end) from a byte array, without copying it."""
        n, size, low_bits, _ = struct.unpack(HEAD, bytes(data[at : at + 24]))
        at += 24
        lines = -(-size // (64 * LINE))
        parts = []
        for words in (lines + 1, lines * LINE, n * low_bits // 64 + 2):
            parts.append(np.frombuffer(data, "<u8", words, at))
            at += 8 * words
        return cls(n, size, low_bits, parts[1], parts[0], parts[2]), at

    def _place(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Place of the k-th one, or zero."""
        directory = self.before[:-1] if ones else self.zeros[:-1]
        line = np.searchsorted(directory, k.astype(directory.dtype), side="right") - 1
        left = k - directory[line].astype(np.int64)
        word = line * LINE
        for _ in range(LINE - 1):
            w = self.high[word]
            count = np.bitwise_count(w if ones else ~w).astype(np.int64)
            go = left >= count
            if not go.any():
                break
            left = left - np.where(go, count, 0)
            word = word + go
        w = self.high[word]
        return word * 64 + select_in_word(w if ones else ~w, left)

    def low_of(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), U)
        at = i * self.low_bits
        shift = (at & 63).astype(U)
        value = self.low[at >> 6] >> shift
        over = (at & 63) + self.low_bits > 64
        value = np.where(over, value | (self.low[(at >> 6) + 1] << ((U(64) - shift) & U(63))), value)
        return value & U((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, dtype=np.int64)
        top = (self._place(i, True) - i).astype(U)
        return (top << U(self.low_bits)) | self.low_of(i)

    def _search(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first number not below each of `wanted`, whether it is equal)."""
        wanted = np.asarray(wanted, dtype=U)
        out, same = np.full(len(wanted), self.n, np.int64), np.zeros(len(wanted), bool)
        if not self.n:
            return out, same
        top = (wanted >> U(self.low_bits)).astype(np.int64)
        rest = wanted & U((1 << self.low_bits) - 1)
        live = np.flatnonzero(top < self.size - self.n)  # the last number's high part is size - n - 1
        top, rest = top[live], rest[live]
        low = np.zeros(len(live), np.int64)
        inner = top > 0
        low[inner] = self._place(top[inner] - 1, False) - top[inner] + 1  # numbers before the bucket
        end = self._place(top, False) - top
        high = end.copy()
        # buckets hold two numbers on average, but where numbers lie dense they are long
        busy = np.flatnonzero(low < high)
        while len(busy):
            a, b = low[busy], high[busy]
            middle = (a + b) >> 1
            below = self.low_of(middle) < rest[busy]
            low[busy], high[busy] = np.where(below, middle + 1, a), np.where(below, b, middle)
            busy = busy[low[busy] < high[busy]]
        out[live] = low
        inside = low < end
        same[live[inside]] = self.low_of(low[inside]) == rest[inside]
        return out, same

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Index of the first number not below each of `wanted`; n where there is none."""
        return self._search(wanted)[0]

    def index_of(self, wanted: np.ndarray) -> np.ndarray:
        """Index of the first number equal to each of `wanted`; -1 where there is none."""
        found, same = self._search(wanted)
        return np.where(same, found, -1)
