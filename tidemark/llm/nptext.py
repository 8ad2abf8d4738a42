"""Vectorised text work on the bytes of a batch of texts.

A batch is one byte array with a blank after each text. Tokens are byte
ranges; their 64-bit hashes come from one running polynomial sum, so no
Python loop touches single words.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = {"n": 0, "up": None, "down": None}

IS_BLANK = np.zeros(256, bool)
IS_BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: 0 blank, 1 letter, digit or byte of a longer character, 2 anything else.
KIND = np.full(256, 2, np.uint8)
KIND[IS_BLANK] = 0
KIND[48:58] = KIND[65:91] = KIND[97:123] = 1
KIND[128:] = 1


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        n = max(n, 1 << 20)
        up, down = np.full(n, _BASE), np.full(n, _INVERSE)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            _powers.update(n=n, up=np.cumprod(up), down=np.cumprod(down))
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h.astype(U64, copy=True)
    with np.errstate(over="ignore"):
        h ^= h >> U64(30)
        h *= U64(0xBF58476D1CE4E5B9)
        h ^= h >> U64(27)
        h *= U64(0x94D049BB133111EB)
        h ^= h >> U64(31)
    return h


class Batch:
    """Bytes of several texts, and where each begins."""

    def __init__(self, texts: list[str], lower: bool = False):
        raw = [t.encode("utf-8", "replace") for t in texts]
        self.bytes = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        if lower:
            self.bytes = LOWER[self.bytes]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        self.starts = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
        self.ends = self.starts + lengths
        self._sums = None

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs between blanks."""
        edge = np.diff(IS_BLANK[self.bytes].view(np.int8), prepend=np.int8(1))
        return np.flatnonzero(edge == -1), np.flatnonzero(edge[1:] == 1) + 1

    def pieces(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of word characters and of other signs."""
        kind = KIND[self.bytes]
        change = np.flatnonzero(np.diff(kind, prepend=np.uint8(0)))
        ends = np.append(change[1:], len(kind))
        keep = kind[change] > 0
        return change[keep], ends[keep]

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        up, down = powers(len(self.bytes) + 1)
        with np.errstate(over="ignore"):
            if self._sums is None:
                self._sums = np.zeros(len(self.bytes) + 1, U64)
                np.cumsum((self.bytes.astype(U64) + U64(1)) * up[: len(self.bytes)], out=self._sums[1:])
            return mix((self._sums[ends] - self._sums[starts]) * down[starts])

    def grams(self, q: int) -> np.ndarray:
        """Hash of the q bytes from each position on (the last q - 1 have none)."""
        n = len(self.bytes) - q + 1
        if n <= 0:
            return np.zeros(0, U64)
        self.hashes(np.zeros(0, np.int64), np.zeros(0, np.int64))
        _, down = powers(len(self.bytes) + 1)
        with np.errstate(over="ignore"):
            return mix((self._sums[q:] - self._sums[:n]) * down[:n])

    def text_of(self, positions: np.ndarray) -> np.ndarray:
        """The number of the text that holds each byte position."""
        return np.searchsorted(self.starts, positions, side="right") - 1

    def string(self, start: int, end: int) -> str:
        return self.bytes[start:end].tobytes().decode("utf-8", "replace")


def shingles(words: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and owner of each run of `size` words of one text."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    same = owner[:n] == owner[size - 1 :]
    total = np.zeros(n, U64)
    with np.errstate(over="ignore"):
        for k in range(size):
            total = total * U64(0xD6E8FEB86659FD93) + words[k : n + k]
    return mix(total[same]), owner[:n][same]


def chunks(texts: list[str], limit: int = 1_500_000):
    """Slices of the list whose characters sum to about `limit`; each text whole."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)
