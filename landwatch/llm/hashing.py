"""Vectorised 64-bit hashes of words and byte grams over flat byte arrays."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = np.ones(1, U)
_INVERSE = np.ones(1, U)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit value over all others, one to one."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x = x ^ (x >> U(27))
    x = x * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


#: One random-looking value a byte.
BYTES = mix(np.arange(1, 257, dtype=U) * U(_BASE))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSE
    if len(_POWERS) < n:
        size = max(n + n // 8, 1 << 16)
        step = np.full(size, _BASE, U)
        back = np.full(size, pow(_BASE, -1, 1 << 64), U)
        step[0] = back[0] = 1
        _POWERS, _INVERSE = np.cumprod(step), np.cumprod(back)
    return _POWERS[:n], _INVERSE[:n]


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    """C with C[i] = sum of value(raw[j]) * base^j over j < i, modulo 2^64."""
    out = np.zeros(len(raw) + 1, U)
    np.cumsum(BYTES[raw] * _powers(len(raw))[0], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span; equal bytes have equal hashes wherever they stand."""
    back = _powers(len(sums))[1]
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(U))


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without space, tab or line break, and each text's count of them."""
    inside = np.zeros(len(raw) + 1, bool)
    inside[:-1] = ~SPACE[raw]
    first = inside[:-1].copy()
    first[1:] &= ~inside[:-2]
    cut = offsets[1:-1]
    cut = cut[cut < len(raw)]
    first[cut] = inside[cut]  # a text begins a new word even without a space
    starts = np.flatnonzero(first)
    space = np.flatnonzero(~inside)
    ends = space[np.searchsorted(space, starts)]
    owner_end = offsets[np.searchsorted(offsets, starts, side="right")]
    ends = np.minimum(ends, owner_end)
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and each text's count of words."""
    starts, ends, counts = word_spans(raw, offsets)
    return span_hashes(prefix_sums(raw), starts, ends), counts


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ranges starts[i] .. starts[i] + counts[i] end to end."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(total)
