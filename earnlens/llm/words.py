"""Word and shingle hashes of a text, vectorised over its words.

Words are maximal runs of characters other than ASCII white space: splitting
the UTF-8 bytes does exactly that, and lower-casing the bytes changes A-Z only.
"""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

#: Odd multiplier of the rolling hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def word_hashes(text: str | None, lower: bool = False) -> np.ndarray:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return np.array([xxh3_64_intdigest(w) for w in (raw.lower() if lower else raw).split()], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        out = np.full(max(4096, 1 << (n - 1).bit_length()), base, dtype=np.uint64)
        out[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(out)
    return have[:n]


class Rolling:
    """Hashes of any run of words in constant time each."""

    def __init__(self, hashes: np.ndarray, base: int = BASE, inverse: int = INVERSE):
        self.n = n = len(hashes)
        self.inverse = inverse
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(hashes * powers(base, n), out=self.sums[1:])

    def runs(self, start: np.ndarray, length) -> np.ndarray:
        """Hash of ``length`` words from each ``start``."""
        inv = powers(self.inverse, self.n + 1)
        return (self.sums[start + length] - self.sums[start]) * inv[start]


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted distinct hashes of the text's ``width``-word runs, A-Z
    lower-cased; with fewer words, of the whole sequence; empty without words."""
    w = word_hashes(text, lower=True)
    if not len(w):
        return w
    out = np.zeros(max(1, len(w) - width + 1), dtype=np.uint64)
    for i in range(min(width, len(w))):
        out = mix(out * np.uint64(3) + w[i:i + len(out)])
    if len(w) < width:
        out = mix(out + np.uint64(len(w)))
    return np.unique(out)
