"""Hashes of words and of runs of words, computed for whole batches of texts in numpy.

A run's hash is a polynomial over its items modulo 2^64, taken as a difference of prefix sums and brought to a common
power, so that equal runs have equal hashes wherever they stand; a mixing step follows.
"""

from __future__ import annotations

import numpy as np

CHUNK = 1 << 20
_ODD = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xC2B2AE3D27D4EB4F)


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, as many as were asked for."""

    def __init__(self, base: int):
        self.base, self.inverse, self.made = base, pow(base, -1, 1 << 64), 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.made:
            self.made = max(n, 2 * self.made, 1 << 16)
            out = []
            for base in (self.base, self.inverse):
                x = np.full(self.made, base, np.uint64)
                x[0] = 1
                out.append(np.cumprod(x, dtype=np.uint64))
            self.up, self.down = out
        return self.up[:n], self.down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    def __init__(self):
        self.by_byte, self.by_word, self.by_word_too = (Powers(b) for b in _ODD)

    @staticmethod
    def _prefix(items: np.ndarray, up: np.ndarray) -> np.ndarray:
        out = np.empty(len(items) + 1, np.uint64)
        out[0] = 0
        np.cumsum(items * up, dtype=np.uint64, out=out[1:])
        return out

    def words(self, texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The hash of each word of the texts, and the number of words before each text (one more at the end). Words are
        runs of bytes other than 0x20 and 0x09 to 0x0D. Texts are read CHUNK bytes at a time, whole ones."""
        hashes, borders, n, at = [], [np.zeros(1, np.int64)], 0, 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK):
                size += len(texts[end])
                end += 1
            some, ends = self._words(texts[at:end], lower)
            hashes.append(some)
            borders.append(ends[1:] + n)
            n += len(some)
            at = end
        return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.concatenate(borders)

    def _words(self, texts: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
        joined = b"\n".join(texts) + b"\n"
        data = np.frombuffer(joined.translate(_LOWER) if lower else joined, np.uint8)
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = (data != 32) & ((data < 9) | (data > 13))
        edges = np.diff(inside)
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        up, down = self.by_byte.upto(len(data) + 1)
        sums = self._prefix(data.astype(np.uint64) + np.uint64(1), up[: len(data)])
        hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        lengths = np.array([len(t) + 1 for t in texts], np.int64)
        borders = np.concatenate([[0], np.cumsum(lengths)])
        return hashes, np.searchsorted(starts, borders)

    def prefix(self, hashes: np.ndarray, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """What `runs` needs: prefix sums over the words, and the powers that bring a run to the front."""
        powers = self.by_word_too if second else self.by_word
        up, down = powers.upto(len(hashes) + 1)
        return self._prefix(hashes, up[: len(hashes)]), down

    @staticmethod
    def runs(prefix: tuple[np.ndarray, np.ndarray], starts: np.ndarray, size) -> np.ndarray:
        """The hash of each run of `size` words from `starts` on."""
        sums, down = prefix
        return mix((sums[starts + size] - sums[starts]) * down[starts] + np.asarray(size).astype(np.uint64))


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
