"""Hashing of words, word sequences and byte strings in numpy, over many texts at once."""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = U(pow(int(BASE), -1, 1 << 64))
_random = np.random.default_rng(20240229)
BYTE_VALUES = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
PLACE_VALUES = _random.integers(1, 1 << 63, 64, dtype=np.uint64) | U(1)
SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the powers 0 to n - 1 and their inverses, modulo 2^64; what is longer than 1 MB of text is not kept."""
    if len(_powers["up"]) >= n:
        return _powers["up"][:n], _powers["down"][:n]
    size = max(n, 1 << 16)
    made = []
    for b in (BASE, BASE_INVERSE):
        x = np.full(size, b, np.uint64)
        x[0] = U(1)
        made.append(np.cumprod(x))
    if size <= 1 << 20:
        _powers["up"], _powers["down"] = made
    return made[0][:n], made[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def prefix_sums(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of byte values times powers, and the inverse powers: the parts of any substring's hash."""
    up, down = powers(len(flat) + 1)
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[flat] * up[:-1], out=sums[1:])
    return sums, down


def substring_hashes(sums: np.ndarray, down: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * BASE)


def fixed_hashes(sums: np.ndarray, down: np.ndarray, size: int) -> np.ndarray:
    """``substring_hashes`` of all substrings of one length, by slices."""
    h = sums[size:] - sums[:-size]
    h *= down[: len(h)]
    h += U(size * int(BASE) % (1 << 64))
    return mix(h)


class Texts:
    """Texts as one byte array, each followed by a space: words with their places and hashes."""

    def __init__(self, texts: list[str | bytes | None], lower: bool = False):
        raw = [t if isinstance(t, bytes) else (t or "").encode() for t in texts]
        self.flat = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        sizes = np.array([len(r) + 1 for r in raw], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        hashed = self.flat
        if lower:
            hashed = np.where((hashed >= 65) & (hashed <= 90), hashed + 32, hashed).astype(np.uint8)
        space = SPACES[self.flat]
        edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=np.int8(1)))
        self.word_start, self.word_end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.word_start, self.starts)
        self.counts = np.diff(np.append(self.first, len(self.word_start)))
        sums, down = prefix_sums(hashed)
        self.word_hash = substring_hashes(sums, down, self.word_start, self.word_end)

    def sequences(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on, over all texts; see ``whole`` for those within one text."""
        n = max(0, len(self.word_hash) - k + 1)
        h = np.zeros(n, np.uint64)
        for j in range(k):
            h += self.word_hash[j : j + n] * PLACE_VALUES[j]
        return mix(h)

    def left(self) -> np.ndarray:
        """For each word, the words from it to the end of its text, itself included."""
        return np.repeat(self.first + self.counts, self.counts) - np.arange(len(self.word_hash))

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of x[i : i + w] for each full window, in a few passes whatever w is."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    m, have = x, 1
    while have * 2 <= w:
        m = np.minimum(m[: len(m) - have], m[have:])
        have *= 2
    if have < w:
        m = np.minimum(m[: n], m[w - have : w - have + n])
    return m[:n]


def parts(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Consecutive ranges of items whose sizes sum to about ``most`` at most; an item is never cut."""
    out, at, total = [], 0, 0
    for i, s in enumerate(sizes):
        if total and total + s > most:
            out.append((at, i))
            at, total = i, 0
        total += s
    if at < len(sizes):
        out.append((at, len(sizes)))
    return out
