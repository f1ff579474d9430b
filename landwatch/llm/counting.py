"""Counts of keys in tables of bounded size, and the commonest of many."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def commonest(counts: DataFrame, most: int, number: str = "n") -> int:
    """A count that at most ``most`` rows exceed, as low as sixteenths of a doubling tell apart."""
    step = F.floor(F.log2(F.col(number).cast("double")) * 16).cast("int")
    steps = counts.groupBy(step.alias("_s")).agg(F.count("*").alias("_k"), F.max(number).alias("_m")).orderBy(F.desc("_s"))
    left = most
    for row in steps.toLocalIterator():  # 1024 rows at most
        left -= row._k
        if left < 0:
            return row._m
    return 0


class Tally:
    """Sums of a number by 64-bit key, with columns told by the key; rows leave when more than ``most`` keys are held."""

    def __init__(self, most: int = 1 << 18) -> None:
        self.most, self.waiting, self.rows = most, [], 0

    def add(self, key: np.ndarray, number: np.ndarray, columns: Sequence[pa.Array]) -> pa.RecordBatch | None:
        self.waiting.append((key, number, list(columns)))
        self.rows += len(key)
        if self.rows > 2 * self.most:
            self._merge()
            if self.rows > self.most:
                return self.end()
        return None

    def _merge(self) -> None:
        key, first, back = np.unique(np.concatenate([k for k, _, _ in self.waiting]), return_index=True, return_inverse=True)
        number = np.zeros(len(key), np.int64)
        np.add.at(number, back, np.concatenate([n for _, n, _ in self.waiting]))
        columns = [pa.concat_arrays(parts).take(pa.array(first)) for parts in zip(*(x for _, _, x in self.waiting))]
        self.waiting, self.rows = [(key, number, columns)], len(key)

    def end(self) -> pa.RecordBatch | None:
        """All that is held, as columns ``c0, c1, .. , n``; None if nothing is."""
        if not self.waiting:
            return None
        self._merge()
        _, number, columns = self.waiting[0]
        self.waiting, self.rows = [], 0
        return pa.RecordBatch.from_arrays([*columns, pa.array(number)], names=[*(f"c{i}" for i in range(len(columns))), "n"])
