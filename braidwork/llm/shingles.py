"""Sets of hashed word shingles, worked out per text with numpy."""

from __future__ import annotations

import numpy as np

SIZE = 5
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE = [np.uint64(x | 1) for x in (0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLANK = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])
_powers: dict[str, np.ndarray] = {}


def _table(name: str, base: np.uint64, n: int) -> np.ndarray:
    """Powers of ``base`` modulo 2**64, at least ``n`` of them."""
    if len(_powers.get(name, ())) < n:
        size = 1 << max(12, (n - 1).bit_length())
        found = np.full(size, base, dtype=np.uint64)
        found[0] = 1
        _powers[name] = np.multiply.accumulate(found)
    return _powers[name][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * _PLACE[0]
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """One 64-bit hash per word, A-Z lower-cased."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").translate(_LOWER), dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, dtype=np.uint64)
    inside = np.concatenate([[False], ~_BLANK[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _table("up", _BASE, len(raw)), out=sums[1:])
    spans = (sums[end] - sums[start]) * _table("down", _INVERSE, len(raw))[start]
    return mixed(spans + (end - start).astype(np.uint64) * _PLACE[4])


def shingle_set(text: str | None, size: int = SIZE) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``size`` words; all words as one run where there are fewer."""
    w = word_hashes(text)
    if not len(w):
        return w
    if len(w) < size:
        whole = w.astype(object)
        code = 0
        for x in whole:
            code = (code * int(_BASE) + int(x) + 1) & ((1 << 64) - 1)
        return mixed(np.array([code ^ len(w)], dtype=np.uint64))
    n = len(w) - size + 1
    total = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        total += w[j : j + n] * _PLACE[j]
    return np.unique(mixed(total))


def identity(found: np.ndarray) -> int:
    """A signed 64-bit hash of a whole set."""
    if not len(found):
        return 0
    total = mixed(found).sum(keepdims=True) ^ (np.array([len(found)], dtype=np.uint64) * _BASE)
    code = mixed(total)
    return int(code.view(np.int64)[0])


def parity(found: np.ndarray) -> np.ndarray:
    """A set as bits: how often, odd or even, a hash falls on each of twice as many places as it has entries.

    The number of places is a power of two, 64 at least. Bits of two sets that differ are at most as many
    as their entries that differ; halves laid over each other by XOR are the bits for half the places.
    """
    places = max(64, 2 << max(0, len(found) - 1).bit_length())
    counts = np.bincount((found & np.uint64(places - 1)).astype(np.int64), minlength=places)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.int64)
