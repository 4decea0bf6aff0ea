"""Range asymmetric numeral system over token ids with a static table and interleaved lanes.

A block holds whole documents and decodes alone, given the shared table. Its tokens lie in rows of
`lanes` columns; each lane has a 64-bit state in [2^31, 2^63), and all lanes share one stream of
32-bit words. The encoder goes from the last row to the first, so its states at a row are the
decoder's: those kept every CHECKPOINT_ROWS rows, with the place in the stream, let several
readers start within a block.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LANES = 2048
CHECKPOINT_ROWS = 256
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
HEAD = "<4sIQIIIIIII"  # magic, docs, tokens, lanes, rows, words, checkpoints, bytes of the document list, crc of ids, crc of the rest
MAGIC = b"RANB"


class Table:
    """Frequencies of ids that sum to 2^bits; every id that occurs has one of at least 1."""

    def __init__(self, frequencies: np.ndarray, bits: int):
        self.bits = bits
        self.freq = frequencies.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.limit = (LOW >> np.uint64(bits) << WORD) * self.freq
        self.symbol = self.spread = self.bias = None

    @classmethod
    def fit(cls, counts: np.ndarray) -> Table:
        """The table for `counts` (by id): shares rounded down, 1 at least, the rest by largest remainder."""
        counts = np.asarray(counts, dtype=np.float64)
        present = np.flatnonzero(counts > 0)
        if not len(present):
            return cls(np.array([1 << 12]), 12)
        bits = max(12, int(np.ceil(np.log2(len(present)))) + 3)
        total = 1 << bits
        share = counts[present] / counts[present].sum() * (total - len(present))
        freq = 1 + np.floor(share).astype(np.int64)
        left = total - int(freq.sum())
        freq[np.argsort(-(share - np.floor(share)), kind="stable")[:left]] += 1
        out = np.zeros(len(counts), dtype=np.int64)
        out[present] = freq
        return cls(out, bits)

    def to_bytes(self) -> bytes:
        body = zlib.compress(self.freq.astype("<u4").tobytes())
        return struct.pack("<4sIIII", b"RANT", self.bits, len(self.freq), len(body), zlib.crc32(body)) + body

    @classmethod
    def from_bytes(cls, data: bytes) -> Table:
        magic, bits, size, length, crc = struct.unpack_from("<4sIIII", data)
        body = data[20 : 20 + length]
        if magic != b"RANT" or zlib.crc32(body) != crc:
            raise ValueError("damaged frequency table")
        return cls(np.frombuffer(zlib.decompress(body), "<u4", size), bits)

    def slots(self):
        if self.symbol is None:
            self.symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
            self.spread = self.freq[self.symbol]
            self.bias = np.arange(1 << self.bits, dtype=np.uint64) - self.cum[self.symbol]
        return self.symbol, self.spread, self.bias


def lanes_for(n: int) -> int:
    return max(1, min(LANES, n // 256))


def encode(ids: np.ndarray, table: Table, doc_list: bytes, n_docs: int) -> bytes:
    """One block. `doc_list`: the caller's description of the documents, kept under the checksum."""
    n = len(ids)
    lanes = lanes_for(n)
    rows = -(-n // lanes)
    freq, cum, limit = table.freq[ids], table.cum[ids], table.limit[ids]
    if n and not freq.min():
        raise ValueError("an id is not in the frequency table")
    bits = np.uint64(table.bits)
    x = np.full(lanes, LOW, dtype=np.uint64)
    out, written, marks = [], 0, []
    for row in range(rows - 1, -1, -1):
        a, b = row * lanes, min(n, (row + 1) * lanes)
        own = x[: b - a]
        f = freq[a:b]
        full = own >= limit[a:b]
        words = own[full]
        if len(words):
            out.append(words.astype(np.uint32))
            written += len(words)
            own[full] = words >> WORD
        q = own // f
        x[: b - a] = (q << bits) + (own - q * f) + cum[a:b]
        if row and row % CHECKPOINT_ROWS == 0:
            marks.append((row, written, x.copy()))
    stream = np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)
    points = b"".join(struct.pack("<II", row, written - w) + s.astype("<u8").tobytes() for row, w, s in reversed(marks))
    rest = doc_list + x.astype("<u8").tobytes() + points + stream.astype("<u4").tobytes()
    crc = zlib.crc32(ids.astype("<u4").tobytes())
    return struct.pack(HEAD, MAGIC, n_docs, n, lanes, rows, written, len(marks), len(doc_list), crc, zlib.crc32(rest)) + rest


def parts(block: bytes):
    """(header fields, document list, [(row, word, states)], words) of a block; checks its bytes."""
    magic, docs, n, lanes, rows, words, marks, listed, crc, rest_crc = struct.unpack_from(HEAD, block)
    rest = memoryview(block)[struct.calcsize(HEAD) :]
    if magic != MAGIC or zlib.crc32(rest) != rest_crc:
        raise ValueError("damaged block")
    at = listed
    points = [(0, 0, np.frombuffer(rest, "<u8", lanes, at))]
    at += 8 * lanes
    for _ in range(marks):
        row, word = struct.unpack_from("<II", rest, at)
        points.append((row, word, np.frombuffer(rest, "<u8", lanes, at + 8)))
        at += 8 + 8 * lanes
    return (docs, n, lanes, rows, crc), bytes(rest[:listed]), points, np.frombuffer(rest, "<u4", words, at)


def decode_rows(table: Table, stream: np.ndarray, n: int, lanes: int, point, last: int) -> np.ndarray:
    """Ids of the rows from a checkpoint up to row `last`."""
    symbol, spread, bias = table.slots()
    row, word, states = point
    x = states.astype(np.uint64)
    bits, mask = np.uint64(table.bits), np.uint64((1 << table.bits) - 1)
    out = np.empty(max(0, min(n, last * lanes) - row * lanes), dtype=np.uint32)
    first = row * lanes
    for r in range(row, last):
        a, b = r * lanes, min(n, (r + 1) * lanes)
        own = x[: b - a]
        slot = (own & mask).astype(np.int64)
        out[a - first : b - first] = symbol[slot]
        own = spread[slot] * (own >> bits) + bias[slot]
        low = np.flatnonzero(own < LOW)
        if len(low):
            own[low] = (own[low] << WORD) | stream[word : word + len(low)]
            word += len(low)
        x[: b - a] = own
    return out


def decode(block: bytes, table: Table) -> tuple[np.ndarray, bytes, int]:
    """(ids, document list, documents) of a block, decoded from all its checkpoints and checked."""
    (docs, n, lanes, rows, crc), doc_list, points, stream = parts(block)
    ends = [p[0] for p in points[1:]] + [rows]
    ids = np.concatenate([decode_rows(table, stream, n, lanes, p, end) for p, end in zip(points, ends, strict=True)])
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("checksum of the decoded ids")
    return ids, doc_list, docs
