"""Sets of word shingles as sorted 64-bit hashes, computed with numpy over a text's bytes.

Words are runs of bytes other than space and 0x09-0x0D, A-Z lowered. A shingle is ``width``
consecutive words; a text with fewer words is one shingle, a text without words none. Every
word gets a polynomial hash mod 2**64 from prefix sums, mixed; a shingle mixes the hashes of its
words and their number.
"""

from __future__ import annotations

import hashlib

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers = {1: np.ones(1, np.uint64), -1: np.ones(1, np.uint64)}


def _power(sign: int, n: int) -> np.ndarray:
    """base ** (sign * i) mod 2**64 for i < n; kept and grown."""
    have = _powers[sign]
    base = _BASE if sign > 0 else pow(_BASE, -1, 1 << 64)
    while len(have) < n:
        have = np.concatenate((have, have * np.uint64(pow(base, len(have), 1 << 64))))
    _powers[sign] = have
    return have[:n]


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def word_bounds(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true places."""
    edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def hashes_between(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each stretch."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(raw * _power(1, len(raw)), dtype=np.uint64)))
    own = (sums[ends] - sums[starts]) * _power(-1, len(raw))[starts]
    return _mixed(own + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def combined(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` consecutive hashes."""
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = _mixed(out * np.uint64(_BASE) + words[i : i + n])
    return out


def word_hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-8", "replace").lower(), dtype=np.uint8)  # bytes.lower: A-Z only
    return hashes_between(raw, *word_bounds(~_SPACE[raw]))


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    words = word_hashes(text) if text else np.zeros(0, np.uint64)
    if not len(words):
        return words
    return np.unique(combined(words, min(width, len(words))))


def set_key(shingles: np.ndarray) -> int:
    """A signed 64-bit key that equal sets share."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)
