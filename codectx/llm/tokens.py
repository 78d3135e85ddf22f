"""Hashes of tokens and of runs of tokens, computed over the bytes of many texts at once.

Tokens are the maximal runs of ASCII letters, digits and underscores after lower-casing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np

TOKEN = re.compile(r"[a-z0-9_]+")
#: Bytes that are hashed in one go; a longer text is cut between two tokens, so that memory doesn't grow with it.
PIECE = 1 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)
STEP = 0xD1342543DE82EF95  # odd, so that it has an inverse modulo 2**64
_values = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_inside = np.zeros(256, bool)
_inside[[*range(48, 58), 95, *range(97, 123)]] = True
_values[~_inside] = 0
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of STEP and of its inverse, at least."""
    if not _powers or len(_powers[0]) < n:
        out = []
        for base in (STEP, pow(STEP, -1, 1 << 64)):
            x = np.full(max(n, PIECE), base, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        _powers[:] = out
    return _powers[0], _powers[1]


def _hashed(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of the tokens of some bytes, of which the last is in no token."""
    inside = _inside[b]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edges = np.concatenate(([0], edges))
    start, stop = edges[0::2], edges[1::2]
    up, down = powers(len(b))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_values[b] * up[: len(b)], dtype=np.uint64)))
    h = (sums[stop] - sums[start]) * down[start]
    h ^= h >> np.uint64(32)
    h *= MIX
    return h ^ (h >> np.uint64(29)), start


def token_hashes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the tokens of all texts one after the other, where each text's tokens end). None is empty.

    >>> token_hashes(["a B", None, "b"])[1].tolist()
    [2, 2, 3]
    """
    data = [x.lower().encode("utf-8", "replace") if x else b"" for x in texts]
    b = np.frombuffer(b"\n".join([*data, b""]), np.uint8)
    ends_at = np.cumsum(np.fromiter((len(x) + 1 for x in data), np.int64, len(data)))
    hashes, starts, lo = [], [], 0
    while lo < len(b):
        hi = min(len(b), lo + PIECE)
        while hi < len(b) and _inside[b[hi - 1]]:
            hi += 1
        h, s = _hashed(b[lo:hi])
        hashes.append(h), starts.append(s + lo)
        lo = hi
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(data), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), ends_at)


def owners(ends: np.ndarray) -> np.ndarray:
    """The number of the text of each element."""
    return np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))


def run_hashes(tokens: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(a hash of each run of ``length`` consecutive tokens, where each text's runs end); a text of fewer tokens has none."""
    counts = np.maximum(np.diff(ends, prepend=0) - length + 1, 0)
    n = len(tokens) - length + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.cumsum(counts)
    h = np.zeros(n, np.uint64)
    for k in range(length):
        h = (h ^ tokens[k : k + n]) * MIX
        h ^= h >> np.uint64(29)
    left = np.repeat(ends, np.diff(ends, prepend=0))[:n] - np.arange(n)
    return h[left >= length], np.cumsum(counts)


def portions(texts: Sequence[str], most: int = PIECE) -> Iterator[slice]:
    """Slices of neighbouring texts of together about ``most`` characters, so that what is made of them stays small."""
    lo, size = 0, 0
    for k, x in enumerate(texts):
        size += len(x or "")
        if size >= most:
            yield slice(lo, k + 1)
            lo, size = k + 1, 0
    if lo < len(texts):
        yield slice(lo, len(texts))
