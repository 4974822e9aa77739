"""Words and word shingles of whole texts as 64-bit hashes, over arrays of bytes.

A word is a run of bytes other than U+0020 and U+0009 to U+000D; no other code point
has such a byte in UTF-8. Its hash is a difference of prefix sums of a polynomial
modulo 2**64, brought to a common power and mixed.
"""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
BLOCK = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """At least n powers; the longest array so far is kept."""
    if len(_POWERS.get(base, ())) < n:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        _POWERS[base] = np.cumprod(out)
    return _POWERS[base]


def _hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of the bytes."""
    n = max(1 << 16, len(data) + 1)
    n = BLOCK + 1 if n <= BLOCK else n
    up, down = _powers(BASE, n), _powers(INVERSE, n)
    space = SPACE[data]
    edge = np.flatnonzero(np.diff(np.r_[True, space, True].view(np.uint8)))
    starts, ends = edge[::2], edge[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts]), starts


def word_hashes(texts: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words in turn, and bounds: text k has words bounds[k] to
    bounds[k + 1] - 1. lower: A-Z count as a-z. Works in blocks cut at white space."""
    joined = b" ".join(texts)
    data = np.frombuffer(joined, np.uint8)
    if lower:
        data = LOWER[data]
    hashes, starts, a = [], [], 0
    while a < len(data):
        b = min(len(data), a + BLOCK)
        while b < len(data):  # back to a blank, or on to the next one
            blank = np.flatnonzero(SPACE[data[a:b]])
            if len(blank):
                b = a + int(blank[-1]) + 1
                break
            b = min(len(data), b + BLOCK)
        h, s = _hashes(data[a:b])
        hashes.append(h)
        starts.append(s + a)
        a = b
    h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    s = np.concatenate(starts) if starts else np.empty(0, np.int64)
    begin = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    return h, np.r_[0, np.searchsorted(s, begin)]


def shingle_sets(texts: list[bytes], size: int = 5, lower: bool = True) -> list[np.ndarray]:
    """Each text's sorted distinct shingles of `size` words. A text of fewer words has
    one shingle, its whole sequence; one without words has none."""
    h, bounds = word_hashes(texts, lower)
    scale = _powers(INVERSE, 1 << 16)
    n = len(h)
    grams = np.zeros(max(0, n - size + 1), np.uint64)
    for k in range(size):
        grams += h[k : k + len(grams)] * scale[k + 1]
    grams = mixed(grams)
    out = []
    for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
        if b - a >= size:
            s = np.sort(grams[a : b - size + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        elif b > a:
            out.append(mixed((h[a:b] * scale[1 : b - a + 1]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
