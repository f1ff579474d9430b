"""Token counts of a sentence-piece BPE vocabulary by a compiled deterministic transducer.

A reset is a space mark after another character, a character outside the vocabulary (it costs its
bytes) or what follows one: no vocabulary entry crosses it. Between resets lies a segment. The
encoding of a segment's prefix is known from its last token: of the entries that end at a character,
exactly one stands validly next to the last token before it. So a state is a prefix of a segment with
its last token, and its transitions carry the change of the emitted-token count. States are compiled
when first met, all new ones of a batch level by level, and kept by hash of the prefix; emptying the
table changes no result.

Texts are not cut into chunks and no state maps of chunks are composed: resets part a text into segments
already. Over a batch one prefix sum of the segments' counts is read off at the texts' ends; a text longer than
a step is one step.

Segments with runs of space marks, whose entries tie in rank, and segments of over ``LONG``
characters apply the merges directly from a heap. Null texts count as empty. Repeated rows give
repeated results; an empty table gives an empty one.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from landwatch.llm.batches import flat, per_batch, strings
from landwatch.llm.bpe import NONE, PairTable
from landwatch.llm.hashing import U, _powers, mix, ragged

MARK = 0x2581
LONG, MOST = 64, 16
#: States that a task keeps.
TABLE = 1_000_000
FREE = ~U(0)


class HashTable:
    """64-bit keys to dense numbers, open addressing, grows by doubling."""

    def __init__(self, bits: int = 16) -> None:
        self.bits, self.size = bits, 0
        self.keys, self.values = np.full(1 << bits, FREE, U), np.zeros(1 << bits, np.int64)

    def get(self, key: np.ndarray) -> np.ndarray:
        """Numbers; -1 for unknown keys."""
        slot = (key >> U(64 - self.bits)).astype(np.int64)
        found = self.keys[slot]
        out = np.where(found == key, self.values[slot], -1)
        ask = np.flatnonzero((found != key) & (found != FREE))
        while len(ask):
            slot[ask] = (slot[ask] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[ask]]
            hit = found == key[ask]
            out[ask[hit]] = self.values[slot[ask[hit]]]
            ask = ask[~hit & (found != FREE)]
        return out

    def add(self, key: np.ndarray) -> None:
        """Number distinct new keys in order."""
        value = np.arange(self.size, self.size + len(key))
        self.size += len(key)
        if self.size * 2 > len(self.keys):
            old = self.keys != FREE
            key, value = np.concatenate([self.keys[old], key]), np.concatenate([self.values[old], value])
            self.bits = int(np.ceil(np.log2(self.size * 4)))
            self.keys, self.values = np.full(1 << self.bits, FREE, U), np.zeros(1 << self.bits, np.int64)
        slot = (key >> U(64 - self.bits)).astype(np.int64)
        while len(key):
            free = self.keys[slot] == FREE
            self.keys[slot[free]] = key[free]
            won = self.keys[slot] == key
            self.values[slot[won]] = value[won]
            key, value, slot = key[~won], value[~won], (slot[~won] + 1) & (len(self.keys) - 1)


def code_sums(code: np.ndarray) -> np.ndarray:
    out = np.zeros(len(code) + 1, U)
    np.cumsum(mix(code.astype(U) + U(1)) * _powers(len(code))[0], out=out[1:])
    return out


def code_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * _powers(len(sums))[1][starts] + (ends - starts).astype(U))


class Vocabulary:
    """Entries by rank, the merges that make them, and which tokens may stand side by side."""

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = {model.id_to_piece(i): i for i in plain}
        score = {i: model.get_score(i) for i in plain}
        by_score = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = np.full(model.vocab_size(), -1, np.int64)  # single characters come before all merges
        trio = []
        for piece, i in self.ids.items():
            if len(piece) > 1:
                self.rank[i] = by_score[score[i]]
                trio += [(self.ids[piece[:k]], self.ids[piece[k:]], i) for k in range(1, len(piece)) if piece[:k] in self.ids and piece[k:] in self.ids]
        self.merge = {(a, b): i for a, b, i in trio}
        self.pairs = PairTable(*np.array(trio, np.int64).reshape(-1, 3).T)
        self.left, self.right = np.full(len(self.rank), -1, np.int64), np.full(len(self.rank), -1, np.int64)
        pieces, numbers = [], []
        for piece, i in self.ids.items():
            parts = self.merged(piece, trace=True)
            if len(parts) == 1:  # else no text has it as a token
                pieces.append(piece)
                numbers.append(i)
                if len(piece) > 1:
                    self.left[i], self.right[i] = self.last
        code = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(p) for p in pieces])
        key = code_hashes(code_sums(code), ends - [len(p) for p in pieces], ends)
        self.entries, self.entry_id = HashTable(17), np.array(numbers, np.int64)
        self.entries.add(key)
        self.known = np.zeros(0x110000, bool)
        self.known[[ord(p) for p in self.ids if len(p) == 1]] = True

    def merged(self, segment: str, trace: bool = False) -> list[int]:
        """Ids of a segment of known characters, by its merges in order of rank, then place."""
        ids = [self.ids[ch] for ch in segment]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = []

        def push(i: int, j: int) -> None:
            if (m := self.merge.get((ids[i], ids[j]))) is not None:
                heapq.heappush(heap, (self.rank[m], i, m, j))

        for i in range(len(ids) - 1):
            push(i, i + 1)
        while heap:
            _, i, m, j = heapq.heappop(heap)
            if ids[i] < 0 or after[i] != j or self.merge.get((ids[i], ids[j])) != m:
                continue
            if trace:
                self.last = ids[i], ids[j]
            ids[i], ids[j] = m, -1
            after[i] = k = after[j]
            if k < len(ids):
                before[k] = i
                push(i, k)
            if before[i] >= 0:
                push(before[i], i)
        return [x for x in ids if x >= 0]

    def adjacent(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Whether the merges of the two tokens' characters end in just these two.

        Walks the border back in time: the later made of the two is taken apart, and no merge across
        the border may come before the merge that ended the pair.
        """
        ok = np.ones(len(one), bool)
        at = np.arange(len(one))
        a, b = one.copy(), two.copy()
        stop_a, stop_b = np.full(len(a), NONE, np.int64), np.full(len(a), NONE, np.int64)
        while len(at):
            m = self.pairs.get(a, b)
            some = m != NONE
            rank = np.where(some, self.rank[np.where(some, m, 0)], NONE)
            crossed = some & (rank < stop_a) & (rank <= stop_b)
            ok[at[crossed]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~crossed & ((ra >= 0) | (rb >= 0))
            at, a, b, stop_a, stop_b, ra, rb = at[go], a[go], b[go], stop_a[go], stop_b[go], ra[go], rb[go]
            first = ra > rb
            stop_a, stop_b = np.where(first, ra, stop_a), np.where(first, stop_b, rb)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return ok


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Transducer:
    """The states that a task has compiled."""

    def __init__(self, path: str) -> None:
        self.vocabulary = vocabulary(path)
        self._empty()

    def _empty(self) -> None:
        self.states = HashTable()
        self.last, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.direct: dict[str, int] = {}

    def _compile(self, sums: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Token counts of distinct segments; new prefixes become states."""
        begin = np.repeat(starts, sizes)
        end = ragged(starts + 1, sizes)
        level = end - begin
        key = code_hashes(sums, begin, end)
        number = self.states.get(key)
        new = np.flatnonzero(number < 0)
        if len(new):
            _, first = np.unique(key[new], return_index=True)
            new = new[first]
            new = new[np.argsort(level[new], kind="stable")]
            base = self.states.size
            self.states.add(key[new])
            number = self.states.get(key)
            self.last = np.concatenate([self.last, np.full(len(new), -1, np.int64)])
            self.count = np.concatenate([self.count, np.zeros(len(new), np.int64)])
            entry = np.full((len(new), MOST + 1), -1, np.int64)
            for size in range(1, MOST + 1):
                rows = np.flatnonzero(level[new] >= size)
                e = end[new[rows]]
                found = self.vocabulary.entries.get(code_hashes(sums, e - size, e))
                entry[rows, size] = np.where(found >= 0, self.vocabulary.entry_id[found], -1)
            bound = np.searchsorted(level[new], np.arange(1, level.max() + 2))
            for k in range(1, len(bound)):
                rows = np.arange(bound[k - 1], bound[k])
                for size in range(min(k, MOST), 0, -1):
                    if not len(rows):
                        break
                    token = entry[rows, size]
                    ask = np.flatnonzero(token >= 0)
                    if size == k:
                        valid, before = np.ones(len(ask), bool), np.zeros(len(ask), np.int64)
                    else:
                        prior = number[new[rows[ask]] - size]
                        valid = self.vocabulary.adjacent(self.last[prior], token[ask])
                        before = self.count[prior]
                    done = rows[ask[valid]]
                    self.last[base + done], self.count[base + done] = token[ask[valid]], before[valid] + 1
                    rows = np.setdiff1d(rows, done, assume_unique=True)
                if len(rows):
                    raise ValueError("a prefix without a valid last token")
        return self.count[number[np.cumsum(sizes) - 1]]

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        """Tokens of each text."""
        if self.states.size > TABLE or len(self.direct) > TABLE:
            self._empty()
        marked = ["▁" + t.replace(" ", "▁") if t else "" for t in texts]
        size = np.array([len(t) for t in marked], np.int64)
        joined = "".join(marked)
        code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        if not len(code):
            return np.zeros(len(texts), np.int64)
        known, mark = self.vocabulary.known[code], code == MARK
        reset = np.zeros(len(code), bool)
        reset[1:] = (mark[1:] & ~mark[:-1]) | ~known[1:] | ~known[:-1]
        ends = np.cumsum(size)
        heads = (ends - size)[size > 0]
        reset[heads] = True
        start = np.flatnonzero(reset)
        wide = np.diff(np.append(start, len(code)))
        tokens = np.zeros(len(start), np.int64)
        alien = ~known[start]
        c = code[start[alien]]
        tokens[alien] = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
        run = np.zeros(len(start), bool)
        two = np.flatnonzero(wide > 1)
        run[two] = mark[start[two]] & mark[start[two] + 1]
        direct = (run | (wide > LONG)) & ~alien
        for i in np.flatnonzero(direct):
            segment = joined[start[i]:start[i] + wide[i]]
            n = self.direct.get(segment)
            if n is None:
                n = self.direct[segment] = len(self.vocabulary.merged(segment))
            tokens[i] = n
        plain = np.flatnonzero(~direct & ~alien)
        if len(plain):
            sums = code_sums(code)
            key = code_hashes(sums, start[plain], start[plain] + wide[plain])
            number = self.states.get(key)
            fresh = np.flatnonzero(number < 0)
            if len(fresh):
                _, first, back = np.unique(key[fresh], return_index=True, return_inverse=True)
                rows = plain[fresh[first]]
                tokens[plain[fresh]] = self._compile(sums, start[rows], wide[rows])[back]
            met = number >= 0
            tokens[plain[met]] = self.count[number[met]]
        scan = np.concatenate([[0], np.cumsum(tokens)])
        return scan[np.searchsorted(start, ends)] - scan[np.searchsorted(start, ends - size)]


def count(df: DataFrame, model: str, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with ``n_bytes`` (UTF-8) and ``n_tokens`` of every whole text.

    ``model`` is the path of a sentence-piece file that every executor can read.
    """

    def make():
        run = Transducer(model)

        def work(part: pa.RecordBatch) -> list[pa.Array]:
            column = part.column(text)
            return [pa.array(np.diff(flat(column)[1]), pa.int64()), pa.array(run(strings(column)), pa.int64())]

        return work

    return per_batch(df, text, keep, [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())], make)
