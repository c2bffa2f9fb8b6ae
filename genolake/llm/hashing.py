"""Vectorized 64-bit hashes of words, shingles and byte strings. All arithmetic wraps modulo 2**64."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SEED = np.random.Generator(np.random.PCG64(20_240_501))
#: A random 64-bit value for each byte; the second table reads A-Z as a-z.
BYTE = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_LOWER = BYTE.copy()
BYTE_LOWER[65:91] = BYTE[97:123]
#: The six white-space bytes between words.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes hashed at a time, so that the 64-bit arrays stay small however long a text is.
SEGMENT = 1 << 19
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher: each input bit reaches every output bit."""
    x = np.atleast_1d(x)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base, and of its inverse."""
    if len(_powers[0]) < n:
        for k, base in ((0, _BASE), (1, _INVERSE)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums of value * base**position, from which any stretch can be hashed in one step."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0], out=out[1:], dtype=np.uint64)
    return out


def stretches(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the stretches [start, end): equal contents give equal hashes."""
    inverse = powers(len(sums))[1]
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(text: np.ndarray, lower: bool = True) -> np.ndarray:
    """A hash for each word of the text: maximal runs of bytes that are not white space."""
    out, at, n, byte = [], 0, len(text), BYTE_LOWER if lower else BYTE
    while at < n:
        end = min(at + SEGMENT, n)
        if end < n:  # a segment ends at white space; a longer word makes it longer
            gaps = np.flatnonzero(SPACE[text[at:end]])
            while not len(gaps) and end < n:
                end = min(end + SEGMENT, n)
                gaps = np.flatnonzero(SPACE[text[at:end]])
            if end < n:
                end = at + int(gaps[-1]) + 1
        part = text[at:end]
        inside = np.zeros(len(part) + 2, np.int8)
        inside[1:-1] = ~SPACE[part]
        edge = np.diff(inside)
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(start):
            out.append(stretches(prefix_sums(byte[part]), start, stop))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """The distinct k-word shingles of a text, sorted; a text of fewer words is one shingle, one without words none."""
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    x = words[:n].copy()
    for j in range(1, k):
        x = x * np.uint64(0x2545F4914F6CDD1D) + words[j : j + n]
    return np.unique(mix(x + np.uint64(k)))
