"""Language identification with string kernels.

The kernel of two texts counts the character n-grams (n = 1..4, lower case) that are present in
both, over hashed bins, normalised so that every text has 1 with itself. A bounded sample of
labelled texts trains one-versus-rest kernel ridge regression on the Nyström features of a bounded
set of landmarks. As the kernel is linear in the presence vectors, landmarks and regression fold into
one matrix of bins by languages: a batch of texts is scored by one product of its presence matrix.

Null texts and texts without a letter are ``und`` with score 0. Rows with a null language teach
nothing. With nothing to learn from every text is ``und``. Ties go to the first language in order.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landwatch.llm.batches import per_batch, strings
from landwatch.session import cut_lineage

BINS, ORDERS, ROWS = 1 << 16, 4, 64
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def presence(texts: Sequence[str]) -> np.ndarray:
    """A row per text with 1 in the bin of each n-gram that it has, scaled to length 1."""
    out = np.zeros((len(texts), BINS), np.float32)
    codes = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    size = np.array([len(x) for x in codes])
    code = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
    row = np.repeat(np.arange(len(texts), dtype=np.int64) * BINS, size)
    cells, gram = out.reshape(-1), np.zeros(len(code), np.uint32)
    for n in range(1, ORDERS + 1):
        if len(code) < n:
            break
        gram = gram[:len(code) - n + 1] * np.uint32(0x01000193) + code[n - 1:] + np.uint32(n)
        spread = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x9E3779B1)
        same = row[:len(gram)] == row[n - 1:]
        cells[(row[:len(gram)] + (spread >> np.uint32(16)))[same]] = 1
    norm = np.sqrt(out.sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=out, where=norm > 0)


def train(texts: Sequence[str], labels: Sequence[str], landmarks: int = 64, ridge: float = 1e-2) -> tuple[list[str], np.ndarray]:
    """Languages and the folded matrix (bins x languages); the first ``landmarks`` texts of each language are landmarks."""
    names = sorted(set(labels))
    label = np.array([names.index(x) for x in labels])
    chosen = np.concatenate([np.flatnonzero(label == k)[:landmarks] for k in range(len(names))])
    z = presence([texts[i] for i in chosen])
    value, vector = np.linalg.eigh((z @ z.T).astype(np.float64))
    root = vector * np.where(value > 1e-6, 1 / np.sqrt(np.maximum(value, 1e-6)), 0)
    kernel = np.concatenate([presence(texts[i:i + ROWS]) @ z.T for i in range(0, len(texts), ROWS)]).astype(np.float64)
    feature = np.hstack([kernel @ root, np.ones((len(texts), 1))])
    want = np.where(label[:, None] == np.arange(len(names)), 1.0, -1.0)
    rest = 1.0 / np.bincount(label, minlength=len(names))[label]  # languages weigh alike
    weighted = feature * rest[:, None]
    beta = np.linalg.solve(feature.T @ weighted + ridge / len(names) * np.eye(feature.shape[1]), weighted.T @ want)
    folded = z.T.astype(np.float64) @ (root @ beta[:-1])
    return names, np.vstack([folded, beta[-1:]]).astype(np.float32)


def learned(df: DataFrame, learn: Column, ident: str, text: str, lang: str, per_language: int) -> DataFrame:
    """``_id, _text, _lang`` of at most ``per_language`` rows of each language, those of least hash of ``ident``; picked in parallel before they come together."""
    usable = df.where(learn & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    order = Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id")
    picked = usable.select(F.col(ident).alias("_id"), F.col(lang).alias("_lang")).withColumn(
        "_n", F.row_number().over(order)).where(F.col("_n") <= per_language).select("_id").distinct()
    sample = usable.select(F.col(ident).alias("_id"), F.col(text).alias("_text"), F.col(lang).alias("_lang")).join(
        F.broadcast(picked), "_id", "left_semi")  # an id may stand in any number of rows
    place = F.row_number().over(Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id", F.xxhash64("_text")))
    return cut_lineage(sample).withColumn("_n", place).where(F.col("_n") <= per_language).drop("_n")


def fit(df: DataFrame, learn: Column, ident: str, text: str, lang: str, per_language: int) -> tuple[list[str], np.ndarray]:
    """Train on a bounded sample in one task."""
    sample = learned(df, learn, ident, text, lang, per_language)

    def run(batches):
        texts, labels = [], []
        for b in batches:
            texts += b.column("_text").to_pylist()
            labels += b.column("_lang").to_pylist()
        if texts:
            names, matrix = train(texts, labels)
            yield pa.RecordBatch.from_arrays([pa.array([names]), pa.array([matrix.tobytes()])], names=["names", "matrix"])

    row = sample.coalesce(1).sortWithinPartitions("_id", "_text").mapInArrow(run, "names array<string>, matrix binary").first()
    if row is None:
        return [], np.zeros((BINS + 1, 0), np.float32)
    return list(row.names), np.frombuffer(bytes(row.matrix), np.float32).reshape(BINS + 1, -1)


def predict(df: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", keep: Sequence[str] = ("doc_id",),
            pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Columns ``keep`` with the language of every whole text and a score from 0 to 1."""
    names, matrix = model
    shared = df.sparkSession.sparkContext.broadcast((names, matrix))

    def make():
        langs, weights = shared.value

        def work(part: pa.RecordBatch) -> list[pa.Array]:
            texts = strings(part.column(text))
            known = [bool(langs) and LETTER.search(t) is not None for t in texts]
            found, value = [UNKNOWN] * len(texts), np.zeros(len(texts))
            ask = np.flatnonzero(known)
            for i in range(0, len(ask), ROWS):
                rows = ask[i:i + ROWS]
                margin = presence([texts[k] for k in rows]) @ weights[:-1] + weights[-1]
                best = margin.argmax(axis=1)
                value[rows] = np.clip((margin.max(axis=1) + 1) / 2, 0, 1)
                for k, b in zip(rows, best):
                    found[k] = langs[b]
            return [pa.array(found, pa.string()), pa.array(value, pa.float64())]

        return work

    return per_batch(df, text, keep, [T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())], make)


def identify(df: DataFrame, learn: Column, ident: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 500,
             keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Fit on the rows that ``learn`` allows and predict every row."""
    return predict(df, fit(df, learn, ident, text, lang, per_language), text, keep)
