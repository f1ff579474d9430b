"""Filters of bounded size over 64-bit hashes, to thin rows before an exact join.

A full filter lets more rows through and costs their shuffle; it never drops one that is asked for.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landwatch.llm.hashing import U

LEAST, MOST = 22, 27


def build(values: DataFrame, column: str) -> np.ndarray:
    """Words of a bit set with about 16 bits a value, 2^27 bits (16 MB) at most."""
    n = values.count()
    bits = min(MOST, max(LEAST, int(16 * n).bit_length()))
    spot = values.select(F.shiftrightunsigned(column, 64 - bits).alias("_k")).distinct()
    words = spot.groupBy(F.shiftright("_k", 6).alias("_w")).agg(F.expr("bit_or(shiftleft(1L, cast(_k % 64 as int)))").alias("_bits"))
    out = np.zeros(1 << (bits - 6), np.int64)
    for row in words.toLocalIterator():  # at most one row a word
        out[row._w] = row._bits
    return out


def held(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    spot = hashes.view(U) >> U(64 - (len(words).bit_length() - 1 + 6))
    return (words.view(U)[(spot >> U(6)).astype(np.int64)] >> (spot & U(63))) & U(1) == 1
