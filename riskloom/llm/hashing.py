"""Vectorised 64-bit hashes of words and word shingles (numpy, a few megabytes of text at a time).

A word's hash is a polynomial in its bytes modulo 2^64 over a fixed random
table, finished by a bijective mixer; it depends on the word alone, on every
worker alike.  Two different words share a hash with probability near 2^-64.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
BLANK = bytes([32, 9, 10, 11, 12, 13])
#: Folds A-Z; white space becomes a blank.
FOLD = bytes(32 if b in BLANK else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Folds A-Z; all that is no ASCII letter or digit and below U+0080 becomes a blank.
FOLD_ALNUM = bytes((b + 32 if 65 <= b <= 90 else b)
                   if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64 (a bijection)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE_VALUE = mix(np.arange(1, 257, dtype=U) * BASE)


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, BASE, dtype=U), np.full(size, INVERSE, dtype=U)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i < n (kept for sizes rounded up to a power of two)."""
    return _powers(max(1 << 20, 1 << (n - 1).bit_length()))


def word_bounds(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, word starts, word ends, text number of each word); blanks (32) part words."""
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)
    word = data != 32
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    offsets = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    return data, starts, ends, np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, offsets), prepend=0))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of data[s:e] for each pair."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=U)
    np.cumsum(BYTE_VALUE.take(data) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every word, in order."""
    data, starts, ends, owner = word_bounds(texts)
    return range_hashes(data, starts, ends), owner


def shingle_hashes(words: np.ndarray, owner: np.ndarray, n_texts: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every run of ``width`` words; a shorter text that has words is one run."""
    counts = np.bincount(owner, minlength=n_texts)
    first = np.cumsum(counts) - counts
    out, own = np.empty(0, dtype=U), np.empty(0, dtype=np.int64)
    if len(words) >= width:
        n = len(words) - width + 1
        whole = owner[:n] == owner[width - 1:]
        h = np.zeros(n, dtype=U)
        for k in range(width):
            h = mix(h * BASE + words[k:k + n] + U(k))
        out, own = h[whole], owner[:n][whole]
    extra_h, extra_o = [], []
    for t in np.flatnonzero((counts > 0) & (counts < width)):
        h = np.zeros(1, dtype=U)
        for k in range(counts[t]):
            h = mix(h * BASE + words[first[t] + k:first[t] + k + 1] + U(k))
        extra_h.append(mix(h + U(counts[t])))
        extra_o.append(t)
    if extra_h:
        out, own = np.concatenate([out, *extra_h]), np.concatenate([own, np.array(extra_o, dtype=np.int64)])
        order = np.argsort(own, kind="stable")
        out, own = out[order], own[order]
    return out, own
