"""Polynomial hashes over whole byte strings, the same on every machine."""

from __future__ import annotations

import numpy as np

from . import common

#: Any odd number has an inverse modulo 2^64, which makes a substring's hash independent of its place.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64; kept by the worker and grown by doubling."""
    held = common.worker_state().__dict__.setdefault("powers", {})
    have = held.get(base)
    if have is None or len(have) < n:
        have, step = np.ones(1, dtype=np.uint64), base
        while len(have) < max(n, 4096):
            have = np.concatenate([have, have * np.uint64(step)])
            step = step * step & _MASK
        if len(have) <= 1 << 22:
            held[base] = have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of (byte + 1) * base^place before each place, for substring_hashes."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), out=out[1:])
    return out


def substring_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mixed((sums[ends] - sums[starts]) * _powers(_INVERSE, len(sums))[starts])


def word_hashes(data: bytes) -> np.ndarray:
    """A hash of each word of data, in which spaces alone part words."""
    x = np.frombuffer(data, dtype=np.uint8)
    edge = np.diff(np.concatenate([[0], (x != 32).view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return substring_hashes(prefix_sums(x), starts, ends)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` words; of all words where they are fewer, but not none."""
    if len(words) == 0:
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        out = out * np.uint64(_BASE) + words[k : n + k]
    return mixed(out)


def labelled(codes: np.ndarray) -> np.ndarray:
    """Codes made distinct by how often each one has occurred before."""
    order = np.argsort(codes, kind="stable")
    s = codes[order]
    first = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
    if first.all():
        return codes
    at = np.arange(len(s))
    nth = at - np.maximum.accumulate(np.where(first, at, 0))
    out = np.empty_like(codes)
    out[order] = mixed(s + nth.astype(np.uint64) * np.uint64(_BASE))
    out[order[first]] = s[first]
    return out
