"""Words and hashed word shingles of texts, by the batch."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile("[a-z0-9]+")
_CACHE: dict[str, int] = {}
_CACHE_WORDS = 1 << 19
_MULT = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[str]) -> list[int]:
    if len(_CACHE) > _CACHE_WORDS:
        _CACHE.clear()
    out = []
    for w in words:
        h = _CACHE.get(w)
        if h is None:
            h = _CACHE[w] = xxhash.xxh3_64_intdigest(w)
        out.append(h)
    return out


def shingle_sets(texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text: hashes sorted within a text, and the bounds of each text in them (one more than texts)."""
    flat: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if text:
            words = word_hashes(WORD.findall(text.lower()))
            counts[i] = len(words)
            flat += words
    h = np.array(flat, np.uint64)
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    doc = np.repeat(np.arange(len(texts)), counts)
    code = np.zeros(n, np.uint64)
    for k in range(size):
        code = mix(code * _MULT[1] + h[k : k + n] * _MULT[0] + _MULT[2])
    inside = doc[:n] == doc[size - 1 :]
    code, doc = code[inside], doc[:n][inside]
    order = np.lexsort((code, doc))
    code, doc = code[order], doc[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
    code, doc = code[new], doc[new]
    return code, np.searchsorted(doc, np.arange(len(texts) + 1))


def overlaps(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0
