"""Hashes of windows of symbols and their minimiser classes, for whole batches of texts at once.

Symbols are bytes (unsigned 8-bit) or word hashes (unsigned 64-bit).
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_table = (np.random.default_rng(400).integers(0, 1 << 64, 256, np.uint64) | np.uint64(1)).astype(np.uint64)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if len(_powers["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, b in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


class Hashed:
    """Prefix hashes of an array of symbols: hashes of any ranges of it."""

    def __init__(self, data: np.ndarray):
        up, self.down = _power(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_table[data] if data.dtype == np.uint8 else data | np.uint64(1)) * up[:-1], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Unmixed hashes of the ranges [start, end)."""
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def windows(self, size: int) -> np.ndarray:
        """Mixed hashes of all windows of a size."""
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by block prefix and suffix minima."""
    n = len(x)
    if n < width:
        return x[:0]
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    square = padded.reshape(blocks, width)
    left = np.minimum.accumulate(square, axis=1).ravel()
    right = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def classes(data: np.ndarray, ends: np.ndarray, size: int = 400, gram: int = 64) -> dict[str, np.ndarray]:
    """Runs of windows of each text that share their minimiser.

    data holds the texts one after the other (2^28 symbols at most, as places are packed in 28
    bits), ends where each ends. A run has its text, first
    window ``a``, number of windows ``n``, distance ``off`` of the minimiser from ``a``, the
    minimiser's hash ``g``, and the hash ``c`` of all bytes its windows cover (with off).
    Which gram is the least of a window depends on the window's bytes alone, so equal windows
    have equal minimisers at equal distance.
    """
    if len(data) > 1 << 28:
        raise ValueError("a batch holds 2^28 symbols at most")
    starts = np.concatenate([[0], ends[:-1]])
    hashed = Hashed(data)
    grams = hashed.windows(gram)
    if len(data) < size:
        empty = np.zeros(0, np.int64)
        return {"doc": empty, "a": empty, "n": empty, "off": empty, "g": empty.view(np.uint64), "c": empty.view(np.uint64)}
    packed = (grams >> np.uint64(28) << np.uint64(28)) | np.arange(len(grams), dtype=np.uint64)
    at = (sliding_least(packed, size - gram + 1) & np.uint64((1 << 28) - 1)).astype(np.int64)
    valid = np.zeros(len(at) + 1, np.int32)
    long = ends - starts >= size
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, ends[long] - size + 1, -1)
    valid = np.cumsum(valid[:-1]) > 0
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
    new[starts[long]] = True
    a = np.flatnonzero(new)
    stop = valid.copy()
    stop[:-1] &= ~valid[1:] | new[1:]
    n = np.flatnonzero(stop) + 1 - a
    off = at[a] - a
    content = mix(hashed.ranges(a, a + n - 1 + size) + off.astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + n.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))
    return {"doc": np.searchsorted(ends, a, side="right"), "a": a, "n": n, "off": off, "g": grams[at[a]], "c": content}
