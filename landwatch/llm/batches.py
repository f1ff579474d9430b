"""Arrow batches of texts as flat byte arrays, and row-wise operators on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one step of a kernel works on; a longer single text is a step of its own.
STEP = 1 << 20
#: Rows of an Arrow batch: a batch of documents stands in memory several times, in both processes.
BATCH = 1000


def small_batches(spark: SparkSession) -> SparkSession:
    """Lower the session's Arrow batch size to ``BATCH`` rows unless it is smaller already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH:
        spark.conf.set(key, BATCH)
    return spark


def unused(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``docs`` has it."""
    taken = {k.lower() for k in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, column: str, step: int = STEP) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about ``step`` bytes."""
    if batch.num_rows == 0:
        return
    array = batch.column(column)
    ends = np.cumsum(lengths(array))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + step, side="right")))
        yield batch.slice(at, to - at)
        at = to


def lengths(array: pa.Array) -> np.ndarray:
    """Bytes of each value; 0 for null."""
    return flat(array)[1][1:] - flat(array)[1][:-1]


def flat(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values end to end, and the offsets of each; null counts as empty."""
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) else b"")
    _, offsets, data = array.buffers()
    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    at = np.frombuffer(offsets, kind)[array.offset:array.offset + len(array) + 1].astype(np.int64) if offsets else np.zeros(len(array) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def strings(array: pa.Array) -> list[str]:
    """Python strings; null counts as empty."""
    return ["" if x is None else x for x in array.to_pylist()]


def per_batch(df: DataFrame, text: str, keep: Sequence[str], fields: Sequence[T.StructField], make: Callable[[], Callable], step: int = STEP) -> DataFrame:
    """The columns ``keep`` of ``df`` plus computed ones, row by row and without a shuffle.

    ``make()`` runs once per task and returns a function from a record batch (of ``keep`` and
    ``text``) to the new arrays. A computed column replaces a kept one of the same name.
    """
    names = [f.name for f in fields]
    keep = [k for k in keep if k not in names]
    need = list(dict.fromkeys([*keep, text]))
    schema = T.StructType([*(df.schema[k] for k in keep), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, text, step):
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *work(part)], names=[*keep, *names])

    return df.select(*(F.col(f"`{k}`") for k in need)).mapInArrow(run, schema)


def packed(df: DataFrame, keep: list[str], only: Callable[[pa.RecordBatch], np.ndarray] | None = None) -> DataFrame:
    """Columns ``keep`` with ``_text`` as compressed bytes and its size: texts are shuffled in this form.

    ``only`` says which rows of a batch stay.
    """
    schema = T.StructType([*(df.schema[k] for k in keep), T.StructField("_packed", T.BinaryType()), T.StructField("_size", T.LongType())])

    def run(batches):
        codec = pa.Codec("zstd", compression_level=3)
        for batch in batches:
            if only is not None:
                batch = batch.filter(pa.array(only(batch)))
            for part in slices(batch, "_text", STEP // 2):
                raw, offsets = flat(part.column("_text"))
                made = [codec.compress(raw[a:e].tobytes(), asbytes=True) for a, e in zip(offsets, offsets[1:])]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(made, pa.binary()), pa.array(np.diff(offsets), pa.int64())], names=[*keep, "_packed", "_size"])

    return df.select(*keep, "_text").mapInArrow(run, schema)


def unpacked(batch: pa.RecordBatch, step: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``step`` bytes of text, with ``_text`` as bytes."""
    codec = pa.Codec("zstd")
    ends = np.cumsum(batch.column("_size").to_numpy())
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + step, side="right")))
        part = batch.slice(at, to - at)
        at = to
        text = [codec.decompress(p, n, asbytes=True) for p, n in zip(part.column("_packed").to_pylist(), part.column("_size").to_pylist())]
        yield part.append_column("_text", pa.array(text, pa.binary()))
