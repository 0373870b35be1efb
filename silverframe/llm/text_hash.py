"""Words and word shingles of a batch of texts as 64-bit hashes, computed over the batch's bytes with numpy.

Words are runs of bytes other than the six ASCII white-space bytes; A-Z count as a-z. A word's hash is a
polynomial over random byte values modulo 2**64, taken from running sums and then mixed.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
_VALUE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[65:91] = _VALUE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_NEXT = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[str, np.ndarray] = {}


def _power(which: str, base: int, n: int) -> np.ndarray:
    if len(_powers.get(which, ())) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[which] = np.cumprod(steps, dtype=np.uint64)
    return _powers[which][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, end to end, and the number of words of each text."""
    data = b" ".join(texts) + b" "
    buf = np.frombuffer(data, np.uint8)
    space = _SPACE[buf]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    start, end = edge[::2], edge[1::2]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[buf] * _power("up", _BASE, len(buf)), dtype=np.uint64)])
    found = mix((total[end] - total[start]) * _power("down", _BACK, len(buf))[start])
    limits = np.cumsum([len(t) + 1 for t in texts])
    return found, np.diff(np.searchsorted(start, limits), prepend=0)


def shingles(texts: list[bytes], n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``n``-word shingles, end to end, and their number in each text.

    A text with fewer words has one shingle, its whole sequence of words; one without words has none.
    """
    found, sizes = words(texts)
    size = np.where(sizes >= n, sizes - n + 1, np.minimum(sizes, 1))
    begin = np.cumsum(sizes) - sizes
    at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
    length = np.repeat(np.minimum(sizes, n), size)
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        if (length > k).all():
            out = out * _NEXT + found[at + k]
        else:
            has = length > k
            out[has] = out[has] * _NEXT + found[at[has] + k]
    return mix(out + length.astype(np.uint64)), size


def shingle_strings(text: bytes, n: int = 5) -> list[bytes]:
    """The shingles themselves, repeats included."""
    w = text.translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    if len(w) < n:
        return [b" ".join(w)] if w else []
    return list(map(b" ".join, zip(*(w[i:] for i in range(n)), strict=False)))
