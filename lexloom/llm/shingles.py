"""Word shingles as 64-bit hashes, and MinHash signatures of them."""

from __future__ import annotations

import numpy as np
import xxhash

K = 64
_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_XOR = _rng.integers(0, 2**32, K, dtype=np.uint32)
_MUL = _rng.integers(0, 2**31, K, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
#: Further coordinates, for sets that are compared with many others.
MORE = 192
_XOR2 = _rng.integers(0, 2**32, MORE, dtype=np.uint32)
_MUL2 = _rng.integers(0, 2**31, MORE, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= 200_000:
                self.clear()
            self[word] = h
        return h


_words = _Words()


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_set(text: bytes, n: int = 2) -> np.ndarray:
    """Sorted hashes of the distinct n-word shingles; of fewer words, the whole sequence is one.

    ``bytes.lower`` changes A-Z alone and ``bytes.split`` cuts at space and tab to carriage return.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, _U)
    h = np.fromiter(map(_words.__getitem__, words), _U, len(words))
    width = min(n, len(h))
    out = h[: len(h) - width + 1]
    for i in range(1, width):
        out = mixed(out + _U(0x9E3779B97F4A7C15)) ^ h[i : len(h) - width + 1 + i]
    return np.unique(mixed(out + _U(width)))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Per coordinate, the shingle whose permuted hash is least (itself, not the hash)."""
    low = (shingles >> _U(32)).astype(np.uint32)
    out = np.empty(K, _U)
    for k in range(K):
        out[k] = shingles[np.argmin((low ^ _XOR[k]) * _MUL[k])]
    return out


def further(shingles: np.ndarray) -> np.ndarray:
    """A byte for each of MORE further coordinates."""
    low = (shingles >> _U(32)).astype(np.uint32)
    at = np.fromiter((np.argmin((low ^ x) * m) for x, m in zip(_XOR2, _MUL2)), np.int64, MORE)
    return (mixed(shingles[at]) & _U(255)).astype(np.uint8)


def tokens(sig: np.ndarray, width: int = 1) -> np.ndarray:
    """One 64-bit value per (coordinate, value), or per so many coordinates side by side with their values."""
    each = mixed(sig + np.arange(1, K + 1, dtype=_U) * _U(0xD6E8FEB86659FD93))
    out = each[::width]
    for i in range(1, width):
        out = mixed(out + _U(0x9E3779B97F4A7C15)) ^ each[i::width]
    return out
