"""Byte-level BPE: pieces of a text as rows of padded matrices, merged in rounds.

``encode`` cuts a text by the split pattern and encodes every distinct piece of a batch once. New
pieces are put in matrices by length; in each round every row merges its leftmost pair of least
rank, found by hashed lookup, the row is compacted, and rows without a pair leave the matrix. A piece
longer than the widest matrix takes the same merges from a heap, as rounds over one row would cost
its length squared. Each task keeps a bounded table of encoded pieces; emptying it changes no result.

Null texts count as empty and give no ids. Other columns are ignored unless named in ``keep``.
Repeated rows give repeated results; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from landwatch.llm.batches import flat, per_batch, strings
from landwatch.llm.hashing import U, mix, ragged

WIDTHS = (4, 8, 12, 16, 24, 32, 64, 128, 256)
NONE = np.int32(2**31 - 1)
#: Encoded pieces that a task keeps.
TABLE = 200_000
ROWS = 1 << 14


class PairTable:
    """Open addressing from a pair of ids to a value; ``NONE`` for an unknown pair."""

    def __init__(self, left: np.ndarray, right: np.ndarray, value: np.ndarray) -> None:
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 4))))
        self.keys = np.full(1 << self.bits, ~U(0), U)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        key, value = self._key(left, right), value.astype(np.int32)
        slot = self._slot(key)
        while len(key):
            free = self.keys[slot] == ~U(0)
            self.keys[slot[free]] = key[free]  # of several for one slot the last stays
            won = self.keys[slot] == key
            self.values[slot[won]] = value[won]
            key, value, slot = key[~won], value[~won], (slot[~won] + 1) & (len(self.keys) - 1)

    @staticmethod
    def _key(left, right):
        return (left.astype(U) << U(32)) | right.astype(U)

    def _slot(self, key):
        return (mix(key) >> U(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = self._key(left, right)
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.values[slot], NONE)
        ask = np.flatnonzero((found != key) & (found != ~U(0)))
        while len(ask):
            slot[ask] = (slot[ask] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[ask]]
            hit = found == key[ask]
            out[ask[hit]] = self.values[slot[ask[hit]]]
            ask = ask[~hit & (found != ~U(0))]
        return out


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte strings of a rank file and their ranks."""
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return ranks


class Entries:
    """The byte strings of a vocabulary end to end, by rank: all that decoding reads."""

    def __init__(self, path: str) -> None:
        ranks = read_ranks(path)
        tokens = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            tokens[r] = t
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.raw = np.frombuffer(b"".join(tokens), np.uint8)


class Ranks:
    """A vocabulary of byte strings by rank, with its pairs as plain arrays."""

    def __init__(self, path: str) -> None:
        ranks = read_ranks(path)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        found = (v for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks for v in (ranks[t[:k]], ranks[t[k:]], r))
        self.trio = np.fromiter(found, np.int32).reshape(-1, 3)
        self.pairs = PairTable(*self.trio.astype(np.int64).T)

    @cached_property
    def lookup(self) -> dict[tuple[int, int], int]:
        """Rank of a pair; made for the first long piece only, as it takes many times the arrays' memory."""
        return {(a, b): r for a, b, r in self.trio.tolist()}

    def encode_matrix(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Merge the rows of a padded matrix of single-byte ids in place of the first ``counts`` entries; returns the new counts."""
        rows, width = ids.shape
        out, left = np.full((rows, width), -1, np.int32), np.zeros(rows, np.int64)
        alive, work, size = np.arange(rows), ids.copy(), counts.astype(np.int64).copy()
        ranks = self.pairs.get(work[:, :-1].ravel(), work[:, 1:].ravel()).reshape(rows, width - 1)
        ranks[np.arange(width - 1) >= size[:, None] - 1] = NONE
        while len(alive):
            at = ranks.argmin(axis=1)  # the leftmost of least rank
            row = np.arange(len(alive))
            best = ranks[row, at]
            ended = best == NONE
            if ended.any():
                done = alive[ended]
                out[done, :work.shape[1]] = work[ended]
                left[done] = size[ended]
                keep = ~ended
                alive, work, ranks, size, at, best = alive[keep], work[keep], ranks[keep], size[keep], at[keep], best[keep]
                row = np.arange(len(alive))
                if not len(alive):
                    break
            work[row, at] = best
            n, wide = work.shape
            stay = np.ones((n, wide), bool)
            stay[row, at + 1] = False
            work = work[stay].reshape(n, wide - 1)
            size -= 1
            if wide == 2:
                ranks = np.full((n, 1), NONE, np.int32)
                continue
            gone = np.ones((n, wide - 1), bool)
            gone[row, at] = False
            ranks = ranks[gone].reshape(n, wide - 2)
            before, after = at > 0, at < size - 1
            r, a = row[before], at[before]
            ranks[r, a - 1] = self.pairs.get(work[r, a - 1], work[r, a])
            r, a = row[after], at[after]
            ranks[r, a] = self.pairs.get(work[r, a], work[r, a + 1])
            r, a = row[~after], at[~after]
            inside = a < wide - 2
            ranks[r[inside], a[inside]] = NONE
        ids[:] = out
        return left

    def encode_long(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece, by a heap of (rank, position)."""
        ids = [int(x) for x in self.single[np.frombuffer(piece, np.uint8)]]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(r, i) for i in range(len(ids) - 1) if (r := self.lookup.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else len(ids)
            if j >= len(ids) or self.lookup.get((ids[i], ids[j])) != rank:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k < len(ids):
                before[k] = i
                if (r := self.lookup.get((rank, ids[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := self.lookup.get((ids[h], rank))) is not None:
                heapq.heappush(heap, (r, h))
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode_pieces(self, pieces: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces end to end, and the count of each."""
        size = np.array([len(p) for p in pieces], np.int64)
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        starts = np.cumsum(size) - size
        parts, counts = [], np.zeros(len(pieces), np.int64)
        order: list[np.ndarray] = []
        low = 1
        one = np.flatnonzero(size == 1)
        parts.append(self.single[raw[starts[one]]])
        counts[one] = 1
        order.append(one)
        for width in WIDTHS:
            bucket = np.flatnonzero((size > low) & (size <= width))
            low = width
            for k in range(0, len(bucket), ROWS):
                rows = bucket[k:k + ROWS]
                grid = np.full((len(rows), width), -1, np.int32)
                cells = np.arange(width) < size[rows][:, None]
                grid[cells] = self.single[raw[ragged(starts[rows], size[rows])]]
                counts[rows] = self.encode_matrix(grid, size[rows])
                parts.append(grid[np.arange(width) < counts[rows][:, None]])
                order.append(rows)
        for i in np.flatnonzero(size > low):
            ids = self.encode_long(pieces[i])
            counts[i] = len(ids)
            parts.append(ids)
            order.append(np.array([i]))
        order, found = np.concatenate(order), np.concatenate(parts) if parts else np.zeros(0, np.int32)
        at = np.zeros(len(pieces), np.int64)
        at[order] = np.cumsum(counts[order]) - counts[order]
        return found[ragged(at, counts)], counts


class _Pieces(dict):
    """Numbers of the distinct pieces met so far."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        self.new.append(piece)
        return n


class Encoder:
    """Encodes texts; holds the pieces of one task."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks, self.find = Ranks(path), regex.compile(pattern).findall
        self._empty()

    def _empty(self) -> None:
        self.pieces, self.ids = _Pieces(), np.zeros(0, np.int32)
        self.counts = np.zeros(0, np.int64)

    def __call__(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the offsets of each text."""
        if len(self.pieces) > TABLE:
            self._empty()
        number, per_text, all_numbers = self.pieces.__getitem__, [], []
        for text in texts:
            found = self.find(text)
            per_text.append(len(found))
            all_numbers.extend(map(number, found))
        if self.pieces.new:
            ids, counts = self.ranks.encode_pieces([p.encode() for p in self.pieces.new])
            self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
            self.pieces.new.clear()
        numbers = np.array(all_numbers, np.int64)
        starts = np.cumsum(self.counts) - self.counts
        counts = self.counts[numbers]
        ends = np.concatenate([[0], np.cumsum(counts)])
        return self.ids[ragged(starts[numbers], counts)], ends[np.concatenate([[0], np.cumsum(per_text)]).astype(np.int64)]


def encode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", keep: Sequence[str] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """Columns ``keep`` and the array of token ids of every whole text.

    ``vocabulary`` is the path of a rank file that every executor can read, ``pattern`` the split pattern.
    """

    def make():
        encoder = Encoder(vocabulary, pattern)

        def work(part: pa.RecordBatch) -> list[pa.Array]:
            found, ends = encoder(strings(part.column(text)))
            return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found, pa.int32()))]

        return work

    return per_batch(df, text, keep, [T.StructField(ids, T.ArrayType(T.IntegerType()))], make)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", keep: Sequence[str] = ("doc_id",), decoded: str = "decoded") -> DataFrame:
    """Columns ``keep`` and ``ids`` plus the bytes that the ids stand for; a null array gives no bytes."""
    keep = [*dict.fromkeys([*keep, ids])]
    schema = T.StructType([*(df.schema[k] for k in keep), T.StructField(decoded, T.BinaryType())])

    def run(batches):
        ranks = Entries(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                column = part.column(ids)
                count = np.array([0 if x is None else x for x in column.value_lengths().to_pylist()], np.int64)
                token = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                size = ranks.sizes[token]
                raw = ranks.raw[ragged(ranks.starts[token], size)]
                ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(count)])]
                out = pa.Array.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes())])
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), out.cast(pa.binary())], names=[*keep, decoded])

    return df.select(*keep).mapInArrow(run, schema)
