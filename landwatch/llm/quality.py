"""Quality scores: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Features are word 1- and 2-grams and the same n-grams over word shapes (letters, capitals, digits
and signs with runs collapsed), hashed to bins, valued by the logarithm of their count and scaled to
length 1. Training
makes one sparse FTRL-proximal update a document over a bounded sample of labelled rows; a score is
the logistic of a sparse dot product.

Null texts count as empty; an empty text is scored by the bias alone. Rows with a null label teach
nothing; with nothing to learn from every score is 0.5. Repeated rows of a label weigh as often as
they stand there.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landwatch.llm.batches import flat, per_batch, slices
from landwatch.llm.hashing import SPACE, U, mix, prefix_sums, span_hashes, word_spans
from landwatch.session import cut_lineage

BITS = 18
BIAS = 1 << BITS
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[[*range(97, 123), *range(128, 256)]] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct bins of all texts end to end, their values, and the count of them a text."""
    starts, ends, counts = word_spans(raw, offsets)
    word = span_hashes(prefix_sums(raw), starts, ends)
    shape = _SHAPE[raw]
    stay = np.ones(len(raw), bool)
    stay[1:] = shape[1:] != shape[:-1]
    stay[starts] = True
    stay &= ~SPACE[raw]
    place = np.concatenate([[0], np.cumsum(stay)])
    form = span_hashes(prefix_sums(shape[stay]), place[starts], place[ends])
    owner = np.repeat(np.arange(len(counts)), counts)
    same = owner[1:] == owner[:-1]
    keys, owners = [], []
    for k, h in enumerate((word, form)):
        pair = np.where(h[:-1] == h[1:], U(1), mix(h[:-1] * U(3) + h[1:]))[same] if len(h) else h  # one bin for all repeated words
        for n, x in enumerate((h, pair)):
            keys.append((mix(x + U(2 * k + n + 1)) >> U(64 - BITS)).astype(np.int64))
            owners.append(owner if n == 0 else owner[1:][same])
    both, times = np.unique((np.concatenate(owners) << BITS) | np.concatenate(keys), return_counts=True)
    value = np.log1p(times)
    norm = np.sqrt(np.bincount(both >> BITS, value * value, minlength=len(counts)))
    return both & (BIAS - 1), value / norm[both >> BITS], np.bincount(both >> BITS, minlength=len(counts))


def train(rows: list[tuple[np.ndarray, float, float]], alpha: float = 1.0, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4, rounds: int = 3) -> np.ndarray:
    """FTRL-proximal over (bins, values, label) rows; returns the weights, the bias last."""
    z, n = np.zeros(BIAS + 1), np.zeros(BIAS + 1)

    def weights(i):
        return np.where(np.abs(z[i]) > l1, (np.sign(z[i]) * l1 - z[i]) / ((beta + np.sqrt(n[i])) / alpha + l2), 0)

    for _ in range(rounds):
        for bins, values, label in rows:
            i = np.append(bins, BIAS)
            x = np.append(values, 1.0)
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - s * w
            n[i] += g * g
    return weights(np.arange(BIAS + 1)).astype(np.float32)


def learned(docs: DataFrame, labels: DataFrame, learn: Column, ident: str, text: str, label: str, sample: int) -> DataFrame:
    """``_id, _text, _y`` of at most ``sample`` labelled rows, those of least hash of ``ident``; picked in parallel before they come together."""
    known = labels.where(F.col(label).isNotNull() & learn).select(F.col(ident).alias("_id"), F.col(label).cast("double").alias("_y"))
    order = F.xxhash64(F.lit(8), "_id")
    picked = known.orderBy(order, "_id", "_y").limit(sample)
    rows = docs.select(F.col(ident).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(picked), "_id")  # an id may stand in any number of rows
    return cut_lineage(rows).orderBy(order, "_id", F.xxhash64("_text"), "_y").limit(sample)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, ident: str, text: str, label: str, sample: int) -> np.ndarray:
    """Train on a bounded sample in one task."""
    rows = learned(docs, labels, learn, ident, text, label, sample)

    def run(batches):
        seen = []
        for batch in batches:
            for part in slices(batch, "_text"):
                bins, value, count = features(*flat(part.column("_text")))
                ends = np.cumsum(count)
                seen += [(bins[e - n:e].astype(np.int32), value[e - n:e].astype(np.float32), y) for e, n, y in zip(ends, count, part.column("_y").to_pylist())]
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([train(seen).tobytes()])], names=["weights"])

    row = rows.coalesce(1).sortWithinPartitions(F.xxhash64(F.lit(8), "_id"), "_id", "_text").mapInArrow(run, "weights binary").first()
    return np.frombuffer(bytes(row.weights), np.float32) if row else np.zeros(BIAS + 1, np.float32)


def score(df: DataFrame, weights: np.ndarray, text: str = "text", keep: Sequence[str] = ("doc_id",), out: str = "score") -> DataFrame:
    """Columns ``keep`` with the probability of label 1 for every whole text."""
    shared = df.sparkSession.sparkContext.broadcast(weights)

    def make():
        w = shared.value.astype(np.float64)

        def work(part: pa.RecordBatch) -> list[pa.Array]:
            bins, value, count = features(*flat(part.column(text)))
            owner = np.repeat(np.arange(len(count)), count)
            margin = np.bincount(owner, w[bins] * value, minlength=len(count)) + w[BIAS]
            return [pa.array(1 / (1 + np.exp(-np.clip(margin, -35, 35))))]

        return work

    return per_batch(df, text, keep, [T.StructField(out, T.DoubleType())], make)


def rate(docs: DataFrame, labels: DataFrame, learn: Column, ident: str = "doc_id", text: str = "text", label: str = "quality",
         sample: int = 12_000) -> DataFrame:
    """``ident, score`` of every document; ``learn`` says which labelled rows may teach."""
    return score(docs, fit(docs, labels, learn, ident, text, label, sample), text, (ident,))
