"""Hashes of words and of runs of words, shared by the operators that compare texts.

A word, a run of bytes other than ASCII white space, is hashed whole by XXH3 to 128 bits, of which two 64-bit halves are
used as independent hashes. Runs of words combine these by a polynomial, then scramble the sum. No sum over bytes is
taken, so words built to collide in such sums (Thue-Morse words, for one) do not.
"""

from __future__ import annotations

import re

import numpy as np
from xxhash import xxh3_128_digest

BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: A long text is cut into words in pieces of about so many bytes, so that only hashes of it are held whole.
PIECE = 1 << 18
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    known = _POWERS.get(base)
    if known is None or len(known[0]) < n:
        size = max(n, 1 << 15)
        known = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (base, pow(base, -1, 1 << 64)))
        if size <= 1 << 20:
            _POWERS[base] = known
    return known[0][:n], known[1][:n]


def word_hashes(text: bytes) -> np.ndarray:
    """Two independent 64-bit hashes of each word: an array of n rows and 2 columns."""
    parts, at = [], 0
    while at < len(text) or not parts:
        space = SPACE.search(text, at + PIECE)
        end = space.end() if space else len(text)
        parts.append(b"".join(map(xxh3_128_digest, text[at:end].split())))
        at = end
    return np.frombuffer(parts[0] if len(parts) == 1 else b"".join(parts), np.uint64).reshape(-1, 2)


def rolled(words: np.ndarray, size: int, base: int) -> np.ndarray:
    """A scrambled polynomial of every ``size`` consecutive hashes, by place of the first; from differences of one running sum."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(base, len(words))
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up, out=sums[1:])
    return mix((sums[size:] - sums[:n]) * down[:n])
