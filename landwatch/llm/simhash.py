"""SimHash near-duplicates, exact to three differing bits, by deletion variants of two halves.

A text's fingerprint has a bit where more than half of its word shingles' hashes have it. Of two fingerprints that differ
in at most three bits, one half differs in at most one. So each half is indexed as it is and once for every bit
deleted; fingerprints meet by equality of such a variant and are verified on all 64 bits.

Equal fingerprints are one node. Those one bit apart are merged first by lookup of the flipped values, as a component has
nothing to ask of itself. A variant shared by more than ``FEW`` nodes is not listed in pairs: its nodes are
indexed anew by the halves of what the variant leaves open, to at most 2^11 values at the last of three levels.

Texts are lower-cased in A-Z; words are what stands between space, tab and line breaks. Fewer words than a shingle give
one shingle of all; null texts, empty ones and those without words have fingerprint zero, which links like any other.
Long texts are read whole, one at a time. Repeated rows share a node. A null id takes part by its text; a component is
named by its least id that is not null (null if it has none). Ties: a bit set in exactly half the shingles is zero.
Other columns are ignored, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landwatch.llm import linking
from landwatch.llm.batches import STEP, flat, slices
from landwatch.llm.hashing import U
from landwatch.session import cut_lineage

#: Nodes of a variant that are compared with each other; more are indexed anew.
FEW = 256
#: Bits that two linked fingerprints differ in at most; the halves of the levels need it to be 3 or less.
BITS = 3
SEED = 42
c = F.col


def shingle_hashes(text: bytes, words: int) -> list[int]:
    """XXH64 of every shingle of a text, repeats included."""
    found = text.lower().split()
    if not found:
        return []
    line = b" ".join(found)
    if len(found) <= words:
        return [xxhash.xxh64_intdigest(line, SEED)]
    size = np.fromiter(map(len, found), np.int64, len(found)) + 1
    start = np.cumsum(size) - size
    end = (start + size - 1)[words - 1:].tolist()
    digest, seed = xxhash.xxh64_intdigest, SEED
    return [digest(line[s:e], seed) for s, e in zip(start.tolist(), end)]


def fingerprints(raw: np.ndarray, offsets: np.ndarray, words: int) -> np.ndarray:
    """One 64-bit fingerprint a text."""
    parts, counts = [], np.zeros(len(offsets) - 1, np.int64)
    for i, (a, e) in enumerate(zip(offsets, offsets[1:])):
        own = shingle_hashes(raw[a:e].tobytes(), words)
        counts[i] = len(own)
        parts.append(np.array(own, U))
    out = np.zeros(len(counts), U)
    some = np.flatnonzero(counts)
    if len(some):
        hashes, start = np.concatenate(parts), (np.cumsum(counts) - counts)[some]
        for bit in range(64):
            held = np.add.reduceat(((hashes >> U(bit)) & U(1)).astype(np.int64), start)
            out[some] |= (2 * held > counts[some]).astype(U) << U(bit)
    return out


def signatures(docs: DataFrame, ident: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """``id, print`` of every row."""
    kind = docs.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text", STEP):
                found = fingerprints(*flat(part.column("_text")), words)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(found.view(np.int64))], names=["id", "print"])

    rows = docs.select(c(f"`{ident}`").alias("id"), c(f"`{text}`").alias("_text"))
    return rows.mapInArrow(run, f"id {kind}, print long")


def one_bit_links(nodes: DataFrame) -> DataFrame:
    """Links ``x, y`` of nodes that differ in one bit: the value without a set bit is looked up among the nodes."""
    bit = nodes.select("print", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("_bit")).where("(shiftrightunsigned(print, _bit) & 1L) = 1")
    lower = bit.select(c("print").alias("x"), F.expr("print ^ shiftleft(1L, _bit)").alias("y"))
    return lower.join(nodes.select(c("print").alias("y")), "y").select("x", "y")


def variants(rows: DataFrame, width: int) -> DataFrame:
    """``key, side, print, root, rest``: both halves of ``width`` bits of ``rest``, whole (side -1) and without each of their bits (side: that bit)."""
    each = rows.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(2 * width + 1))))
    mask = (1 << width) - 1
    each = each.withColumn("_half", F.expr(f"_j div {width + 1}").cast("int")).withColumn("_bit", F.expr(f"cast(_j % {width + 1} as int)"))
    high, low = F.expr(f"shiftrightunsigned(rest, {width}) & {mask}L"), F.expr(f"rest & {mask}L")
    each = each.withColumn("_own", F.when(c("_half") == 0, high).otherwise(low)).withColumn("_other", F.when(c("_half") == 0, low).otherwise(high))
    whole = c("_bit") == width
    cut = F.when(whole, c("_own")).otherwise(F.expr("_own & ~shiftleft(1L, _bit)"))
    side = F.when(whole, F.lit(-1)).otherwise(F.expr("cast(shiftrightunsigned(_own, _bit) & 1L as int)"))
    return each.select(F.xxhash64("key", "_half", "_bit", cut).alias("key"), side.alias("side"), "print", "root", c("_other").alias("rest"))


def near_links(rows: DataFrame, live: DataFrame) -> DataFrame:
    """Verified links ``x, y`` between roots, of the variants in ``live``: equal wholes, or the two values of a deleted bit."""
    met = cut_lineage(rows.join(live.select("key"), "key"))
    left = met.select("key", c("side").alias("_s"), c("print").alias("_p"), c("root").alias("x"))
    right = met.select("key", c("side").alias("_t"), c("print").alias("_q"), c("root").alias("y"))
    meet = ((c("_s") == 0) & (c("_t") == 1)) | ((c("_s") == -1) & (c("_t") == -1) & (c("_p") < c("_q")))
    close = F.bit_count(c("_p").bitwiseXOR(c("_q"))) <= BITS
    return left.join(right, "key").where(meet & close & (c("x") != c("y"))).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def components(docs: DataFrame, ident: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """``ident, fingerprint, component_id`` of every row; the fingerprint as 16 hex digits."""
    prints = cut_lineage(signatures(docs, ident, text, words))
    nodes = cut_lineage(prints.groupBy("print").agg(F.min("id").alias("least_id")))
    root = linking.relabel(nodes.select("print", c("print").alias("root")), "root", linking.roots(one_bit_links(nodes)))
    root = cut_lineage(root)
    rows = root.select(F.lit(0).cast("long").alias("key"), "print", "root", c("print").alias("rest"))
    for width in (32, 16, 8):
        made = variants(rows, width)
        told = made.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("_low"), F.max("root").alias("_high"), F.bit_or(F.expr("shiftleft(1, side + 1)")).alias("_sides"))
        live = cut_lineage(told.where("n > 1 and _low < _high and ((_sides & 1) > 0 or (_sides & 6) = 6)").select("key", "n"))
        few = live if width == 8 else live.where(c("n") <= FEW)
        found = linking.roots(near_links(made, few))
        root = cut_lineage(linking.relabel(root, "root", found))
        many = live.where(c("n") > FEW)
        if width == 8 or many.isEmpty():
            break
        rows = cut_lineage(linking.relabel(made.join(many.select("key"), "key"), "root", found).select("key", "print", "root", "rest"))
    least = root.join(nodes, "print").groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = root.join(least, "root").select("print", "component_id")
    out = prints.join(named, "print")
    return out.select(c("id").alias(ident), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
