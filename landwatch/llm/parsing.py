"""Document fingerprints by locally consistent parsing.

A text's bytes are cut into phrases whose borders depend on few neighbours alone. In each level runs of one
name become one name; deterministic coin tossing labels every name by where it first differs in bits
from its left neighbour, twice, until labels are few; a local maximum of the labels begins a phrase;
a phrase's name is the hash of its names. Equal substrings therefore get equal phrases inside,
whatever their offset, up to a short margin at either end. The fingerprint samples the names of all
levels from ``FIRST`` on, and of the last level of a shorter text, by one-permutation hashing: each of
``SLOTS`` slots keeps the low 16 bits of its least name, empty slots borrow from the next full one.
The likeness of two fingerprints is the share of equal slots.

Null texts count as empty; two empty texts have likeness 1, an empty and another one 0. Equal texts
have equal fingerprints. Rows with equal ids are ordered by text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landwatch.llm.batches import STEP, flat, slices, strings
from landwatch.llm.hashing import U, mix, prefix_sums, span_hashes
from landwatch.session import cut_lineage

SLOTS, FIRST = 64, 2
c = F.col


def _coin(own: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Twice the lowest bit in which a name differs from its left neighbour, plus that bit."""
    differ = own ^ left
    low = differ & (~differ + differ.dtype.type(1))
    at = np.frexp(low.astype(np.float64))[1] - 1  # exact for powers of two
    return (2 * at + ((own & low) != 0)).astype(np.uint8)


_PAIR = np.arange(256, dtype=np.uint8)
_BYTE_COIN = _coin(np.tile(_PAIR, 256), np.repeat(_PAIR, 256)).reshape(256, 256)  # [left, own]


def _borders(label: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where a phrase begins: at a text's start and at strict local maxima that follow no such start."""
    top, least = first.copy(), np.zeros_like(label)
    if len(label) > 1:
        least[:-1] = np.where(first[1:], 0, label[1:])  # nothing follows a text's last name
        top[1:] |= (label[1:] > label[:-1]) & (label[1:] >= least[1:])
    # a start right after a text's start would leave a phrase of one name: it gives way
    top[1:] &= ~(top[:-1] & ~first[1:])
    return top


def _second(label: np.ndarray, first: np.ndarray) -> np.ndarray:
    left = np.empty_like(label)
    left[:1], left[1:] = 0, label[:-1]
    out = _BYTE_COIN[left, label]
    out[first] = label[first]
    return out


def names(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per level: its number, the names of all texts end to end, and the count of them a text."""
    size = np.diff(offsets)
    level, owner_counts = 0, size.copy()
    starts = offsets[:-1][size > 0]
    first = np.zeros(len(raw), bool)
    first[starts] = True
    # level 0: runs of a byte, labels from a table
    run = first.copy()
    run[1:] |= raw[1:] != raw[:-1]
    at = np.flatnonzero(run)
    byte, head = raw[at], first[at]
    left = np.empty_like(byte)
    left[:1], left[1:] = 0, byte[:-1]
    label = _BYTE_COIN[left, byte]
    label[head] = byte[head] & 15
    begin = np.flatnonzero(_borders(_second(label, head), head))
    start, end = at[begin], np.append(at[begin[1:]], len(raw)) if len(begin) else at[:0]
    name = span_hashes(prefix_sums(raw), start, end) if len(begin) else np.zeros(0, U)
    head = head[begin]
    counts = np.zeros(len(size), np.int64)
    filled = np.flatnonzero(size > 0)
    while True:
        level += 1
        edge = np.append(np.flatnonzero(head), len(name))
        counts[filled] = np.diff(edge)
        yield level, name, counts
        if not len(name) or counts.max() <= 1:
            return
        run = head.copy()
        run[1:] |= name[1:] != name[:-1]
        at = np.flatnonzero(run)
        length = np.diff(np.append(at, len(name)))
        own, head = name[at], head[at]
        left = np.empty_like(own)
        left[:1], left[1:] = 0, own[:-1]
        label = _coin(own, left)
        label[head] = (own[head] & U(15)).astype(np.uint8)
        begin = np.flatnonzero(_borders(_second(label, head), head))
        # the name of a phrase: a hash of its names, run lengths and their order
        item = mix(own * U(5) + length.astype(U) + U(level))
        place = np.arange(len(item)) - np.repeat(begin, np.diff(np.append(begin, len(item))))
        item = mix(item + mix(place.astype(U)))
        name = mix(np.add.reduceat(item, begin))
        head = head[begin]


def sketch(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The fingerprint of every text, a row of ``SLOTS`` 16-bit values."""
    n = len(offsets) - 1
    least = np.full((n, SLOTS), ~U(0), U)
    kept, owners = [], []
    going = np.ones(n, bool)  # texts with more than one name in the level before
    for level, name, counts in names(raw, offsets):
        owner = np.repeat(np.arange(n), counts)
        use = going[owner] & ((level >= FIRST) | (counts[owner] == 1))  # a text that ends below the first level keeps its last one
        kept.append(mix(name[use] + U(level)))
        owners.append(owner[use])
        going = going & (counts > 1)
    hashed, owner = np.concatenate(kept), np.concatenate(owners)
    cell = owner * SLOTS + (hashed >> U(58)).astype(np.int64)
    np.minimum.at(least.reshape(-1), cell, hashed)
    full = least != ~U(0)
    for _ in range(SLOTS):  # an empty slot takes the next one's value
        gap = ~full & np.roll(full, -1, axis=1)
        if not gap.any():
            break
        least[gap] = mix(np.roll(least, -1, axis=1)[gap])
        full |= gap
    return (least & U(0xFFFF)).astype(np.uint16)


def fingerprints(texts: list[str]) -> np.ndarray:
    return sketch(*flat(pa.array(texts, pa.large_string())))


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by the first as many code points of the one that follows."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _rows(ids: pa.Array, texts: list[str], following: list[str], nexts: np.ndarray | None = None) -> list[pa.Array]:
    """Output columns after the id for texts that know their following ones."""
    made = [edited(a, b) for a, b in zip(texts, following)]
    own, changed = fingerprints(texts), fingerprints(made)
    after = fingerprints(following) if nexts is None else nexts
    words = lambda x: pa.array([r.astype(">u2").tobytes().hex() for r in x], pa.string())
    return [ids, pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in made]),
            words(own), words(changed), pa.array(likeness(own, changed)), pa.array(likeness(own, after))]


def compare_with_next(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``ident, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every document.

    One range shuffle puts the documents in order of id; all but the last row of a partition find
    their next document beside them. The first and last rows of the partitions, with their texts,
    meet by partition number; the last document of all meets the first.
    """
    ids = docs.schema[ident].dataType.simpleString()
    fields = f"_kind int, _part int, _text string, {ident} {ids}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names_ = [f.split()[0] for f in fields.split(", ")]
    ordered = docs.select(c(ident), F.coalesce(c(text), F.lit("")).alias("_text")).repartitionByRange(ident).sortWithinPartitions(
        ident, "_text").select("*", F.spark_partition_id().alias("_part"))
    known = docs.schema[ident].dataType

    def edge(kind: int, part: int, row_text: str, ident_: pa.Array) -> pa.RecordBatch:
        empty = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
        return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([row_text]), ident_, *empty], names=names_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[pa.Array, str] | None = None
        part = 0
        for batch in batches:
            for rows in slices(batch, "_text", STEP // 2):
                part = rows.column("_part")[0].as_py()
                texts, found = strings(rows.column("_text")), rows.column(ident)
                if held is None:
                    yield edge(0, part, texts[0], found.slice(0, 1))
                else:
                    texts, found = [held[1], *texts], pa.concat_arrays([held[0], found])
                if len(texts) > 1:
                    own, n = _rows(found.slice(0, len(texts) - 1), texts[:-1], texts[1:]), len(texts) - 1
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, 2, np.int32)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), *own], names=names_)
                held = found.slice(len(texts) - 1, 1), texts[-1]
        if held is not None:
            yield edge(1, part, held[1], held[0])

    done = cut_lineage(ordered.mapInArrow(run, fields))
    firsts, lasts = done.where("_kind = 0"), done.where("_kind = 1")
    parts = firsts.select("_part")  # one small number a partition
    following = parts.select("_part", F.coalesce(F.lead("_part").over(Window.orderBy("_part")), F.min("_part").over(Window.partitionBy())).alias("_to"))
    met = lasts.select(ident, "_text", "_part").join(following, "_part").join(
        firsts.select(c("_part").alias("_to"), c("_text").alias("_next")), "_to").select(ident, "_text", "_next")

    def border(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "_text"):
                yield pa.RecordBatch.from_arrays(_rows(rows.column(ident), strings(rows.column("_text")), strings(rows.column("_next"))), names=names_[3:])

    out = done.where("_kind = 2").select(*names_[3:])
    return out.unionByName(met.mapInArrow(border, fields.split("_text string, ")[1]))
