"""Word shingles of texts as 63-bit hashes, made by numpy for many texts at a time."""

from __future__ import annotations

import numpy as np

#: Bytes of text that are hashed at a time; a longer text is a piece of its own.
PIECE = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BASE = 0x9E3779B97F4A7C15 | 1
_LETTER = np.random.default_rng(20_240_101).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of x (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n at least."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, PIECE + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        _powers = (np.cumprod(up), np.cumprod(down))
    return _powers


def word_hashes(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of a buffer that ends in white space."""
    space = _SPACE[buffer]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    start, end = edge[::2], edge[1::2]
    up, down = _powers_to(len(buffer) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LETTER[buffer] * up[: len(buffer)])))
    return start, mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words gives the whole sequence as one, none gives none."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) < PIECE):
            size += len(texts[stop]) + 1
            stop += 1
        out += _piece(texts[at:stop], words)
        at = stop
    return out


def _piece(texts: list[bytes], words: int) -> list[np.ndarray]:
    joined = b"".join(t.translate(_LOWER) + b" " for t in texts)
    start, h = word_hashes(np.frombuffer(joined, np.uint8))
    ends = np.cumsum([len(t) + 1 for t in texts])
    cut = np.searchsorted(start, ends)
    turn = mix(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)
    run = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for j in range(words):
        run += h[j : j + len(run)] * turn[j]
    run = mix(run) >> np.uint64(1)
    out, a = [], 0
    for b in cut:
        n = b - a
        if n >= words:
            out.append(np.unique(run[a : b - words + 1]))
        elif n:
            out.append(mix(np.array([(h[a:b] * turn[:n]).sum(dtype=np.uint64) + np.uint64(n)])) >> np.uint64(1))
        else:
            out.append(np.zeros(0, np.uint64))
        a = b
    return out
