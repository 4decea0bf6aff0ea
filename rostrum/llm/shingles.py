"""Word shingles of whole texts as sorted 64-bit hashes, computed for many texts at once."""

from __future__ import annotations

import numpy as np

# A-Z fold to a-z; space and \x09-\x0D separate words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SPACES = [9, 10, 11, 12, 13, 32]
#: Bytes of text hashed at once, to the end of a word; hashing takes about 20 times as much memory.
PIECE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift rounds)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(n: int, seed: int) -> np.ndarray:
    """n reproducible 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


class Hasher:
    def __init__(self, width: int):
        self.width = width
        self.space = np.zeros(256, bool)
        self.space[SPACES] = True
        self.byte = stream(256, 11)
        self.places = stream(width, 12) | np.uint64(1)
        self.base = np.uint64(0xD6E8FEB86659FD93)

    def word_hashes(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(hash, start) of each word of a folded text: a polynomial over random byte values, mixed with its length."""
        raw = np.frombuffer(data, np.uint8)
        if len(raw) <= PIECE_BYTES:
            return self.piece_hashes(raw)
        found, at = [], 0
        while at < len(raw):
            end = min(at + PIECE_BYTES, len(raw))
            while end < len(raw) and not self.space[raw[end]]:  # to the end of the word
                gap = np.flatnonzero(self.space[raw[end : end + 4096]])
                end += int(gap[0]) if len(gap) else min(4096, len(raw) - end)
            hashes, starts = self.piece_hashes(raw[at:end])
            found.append((hashes, starts + at))
            at = end
        return np.concatenate([h for h, _ in found]), np.concatenate([s for _, s in found])

    def piece_hashes(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What `word_hashes` returns, of a text's bytes, in arrays many times as large."""
        if not len(raw):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        edge = np.diff(np.concatenate([[True], self.space[raw], [True]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if not len(starts):
            return np.zeros(0, np.uint64), starts
        length = ends - starts
        out = np.zeros(len(starts), np.uint64)
        values = self.byte[raw]
        order = np.argsort(length, kind="stable")
        done, at = 0, 0
        ranked = length[order]
        while done < len(order):  # one step for each place in a word; words leave as they end
            done = np.searchsorted(ranked, at, side="right")
            live = order[done:]
            if len(live) < 64 and len(live):
                break
            out[live] = out[live] * self.base + values[starts[live] + at]
            at += 1
        for w in order[done:]:  # the few longest words
            rest = values[starts[w] + at : ends[w]]
            h = int(out[w])
            powers = np.full(len(rest), self.base)
            powers[:1] = 1
            powers = np.multiply.accumulate(powers)[::-1]
            lead = np.uint64(pow(int(self.base), len(rest), 1 << 64))
            out[w] = (h * int(lead) + int((rest * powers).sum(dtype=np.uint64))) & 0xFFFFFFFFFFFFFFFF
        return mix(out + length.astype(np.uint64) * self.byte[0]), starts

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle, one without words none."""
        folded = [t.encode("utf-8", "surrogatepass").translate(FOLD) if t else b"" for t in texts]
        lengths = np.array([len(f) + 1 for f in folded])
        words, starts = self.word_hashes(b" ".join(folded))
        ends = np.cumsum(lengths)
        edges = np.searchsorted(starts, np.concatenate([[0], ends]))
        out = []
        w = self.width
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            own = words[a:b]
            if b - a == 0:
                out.append(own)
                continue
            if b - a < w:
                out.append(mix((own * self.places[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
                continue
            n = b - a - w + 1
            total = own[:n] * self.places[0]
            for i in range(1, w):
                total = total + own[i : i + n] * self.places[i]
            codes = np.sort(mix(total))
            out.append(codes[np.concatenate([[True], codes[1:] != codes[:-1]])])
        return out
