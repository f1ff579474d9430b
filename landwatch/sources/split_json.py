"""Elements of an array member of JSON files of any size, one file read by many tasks.

Spark's text reader cuts a file into byte ranges ("blocks") at ``}``. What a brace means depends on all text before it,
so a first pass finds what each block does to the state (inside a string or not, depth) from either start, these
maps are composed along the file (one small row a block), and a second pass cuts elements out of each block from
its true start. Only the elements that a block border cuts are shuffled.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landwatch.session import cut_lineage

c = F.col
STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
REST = re.compile(r'(?:[^"\\]|\\.)*"', re.S)
TOKEN = re.compile(r'"(?:[^"\\]|\\.)*("?)|[{}\[\]]', re.S)
MAPS = "file string, block bigint, quoted0 boolean, depth0 bigint, quoted1 boolean, depth1 bigint"
STARTS = "file string, block bigint, quoted boolean, depth bigint, balanced boolean"
PIECES = "file string, block bigint, n bigint, known boolean, text string, cut boolean, last boolean, inside boolean"
ELEMENT_DEPTH = 2  # root object, member array


def shift(text: str, quoted: bool) -> tuple[int, bool]:
    """(change of depth, whether a string is open at the end) of a piece of JSON."""
    if quoted:
        rest = REST.match(text)
        if rest is None:
            return 0, True
        text = text[rest.end():]
    bare = STRING.sub("", text)
    at = bare.find('"')
    bare = bare if at < 0 else bare[:at]
    return bare.count("{") + bare.count("[") - bare.count("}") - bare.count("]"), at >= 0


def block_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """State map of each block: the end for a start outside (0) and inside (1) a string."""
    open_, state = None, None
    names = [f.split()[0] for f in MAPS.split(", ")]
    row = lambda: pa.RecordBatch.from_pydict(dict(zip(names, [[v] for v in (*open_, *state)])), MAPS_ARROW)
    for batch in batches:
        for file, block, text in zip(*(batch[k].to_pylist() for k in ("file", "block", "value"))):
            if (file, block) != open_:
                if open_:
                    yield row()
                open_, state = (file, block), [False, 0, True, 0]
            for i in (0, 2):
                moved, state[i] = shift(text + "}", state[i])
                state[i + 1] += moved
    if open_:
        yield row()


def compose(table: pa.Table) -> pa.Table:
    """Start of each block of one file; a group holds a row a block, not text."""
    rows, out, quoted, depth = sorted(table.to_pylist(), key=lambda r: r["block"]), [], False, 0
    for r in rows:
        out.append([r["file"], r["block"], quoted, depth])
        k = "1" if quoted else "0"
        quoted, depth = r[f"quoted{k}"], depth + r[f"depth{k}"]
    whole = not quoted and depth <= 0  # the piece behind the last brace is counted as one more brace
    return pa.Table.from_pylist([dict(zip(("file", "block", "quoted", "depth"), r), balanced=whole) for r in out], STARTS_ARROW)


class Cutter:
    """Cuts the elements out of one block; the first one may have begun before it, the last one may go on behind it."""

    def __init__(self, file: str, block: int, quoted: bool, depth: int, member: str):
        self.file, self.block, self.quoted, self.depth, self.member = file, block, quoted, depth, member
        self.inside = None if depth >= ELEMENT_DEPTH else False  # None: as at the block's start
        self.parts: list[str] | None = [] if depth > ELEMENT_DEPTH else None
        self.head, self.known, self.number = depth > ELEMENT_DEPTH, False, 0
        self.count, self.key, self.rows = [0, 0], None, []

    def row(self, cut: bool) -> None:
        self.rows.append((self.file, self.block, self.number, self.known, "".join(self.parts), cut, False, None))

    def feed(self, piece: str) -> None:
        text, at, begin = piece + "}", 0, 0
        if self.quoted:
            rest = REST.match(text)
            if rest is not None:
                at, self.quoted = rest.end(), False
        if self.parts is not None and not self.head and not self.quoted:  # in an element: only the last brace can end it
            moved, self.quoted = shift(text[at:], False)
            self.depth += moved
            self.parts.append(text)
            if self.depth == ELEMENT_DEPTH:
                self.row(False)
                self.parts = None
            return
        for m in TOKEN.finditer(text, at) if not self.quoted else ():
            sign = m.group()[0]
            if sign == '"':
                self.quoted = not m.group(1)
                if self.depth == 1 and not self.quoted:
                    self.key = m.group()
            elif sign in "{[":
                if self.depth == ELEMENT_DEPTH and sign == "{" and self.inside is not False and self.parts is None:
                    self.known, self.parts, begin = bool(self.inside), [], m.start()
                    self.count[self.known] += 1
                    self.number = self.count[self.known]
                elif self.depth == 1:
                    self.inside = sign == "[" and self.key is not None and json.loads(self.key) == self.member
                self.depth += 1
            else:
                self.depth -= 1
                if self.depth == ELEMENT_DEPTH and self.parts is not None:
                    self.parts.append(text[begin:m.end()])
                    if sign == "}":
                        self.row(self.head)
                    self.parts, self.head = None, False
                elif self.depth == 1:
                    self.inside = False
        if self.parts is not None:
            self.parts.append(text[begin:])

    def close(self) -> list[tuple]:
        if self.parts is not None:
            self.row(True)
        return [*self.rows, (self.file, self.block, self.count[0], False, None, False, True, self.inside)]


def cut_blocks(batches: Iterator[pa.RecordBatch], member: str) -> Iterator[pa.RecordBatch]:
    """Elements and parts of elements of each block, and a last row with its count of unknown elements and where it ends."""
    cutter, names = None, ("file", "block", "value", "quoted", "depth")
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), PIECES_ARROW)], schema=PIECES_ARROW)
    for batch in batches:
        for file, block, text, quoted, depth in zip(*(batch[k].to_pylist() for k in names)):
            if cutter is None or (file, block) != (cutter.file, cutter.block):
                if cutter is not None:
                    yield pack(cutter.close())
                cutter = Cutter(file, block, quoted, depth, member)
            cutter.feed(text)
        if cutter is not None and cutter.rows:
            yield pack(cutter.rows)
            cutter.rows = []
    if cutter is not None:
        yield pack(cutter.close())


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[t]) for n, t in (f.split() for f in ddl.split(", "))])


MAPS_ARROW, STARTS_ARROW, PIECES_ARROW = map(arrow_schema, (MAPS, STARTS, PIECES))


def array_elements(spark: SparkSession, path: str, member: str) -> DataFrame:
    """(file, seq, text) of the objects in the array ``member`` of each file's root object; seq counts them from 0.

    Files are valid JSON in UTF-8; elements that are no objects are left out, and a file that ends early gives no rows.
    The starts of blocks are broadcast: one row per ``spark.sql.files.maxPartitionBytes`` of input. A block whose
    start is missing, as when files change between the passes, fails the job.
    """
    pieces = spark.read.option("lineSep", "}").text(path).select(
        "value", c("_metadata.file_path").alias("file"), c("_metadata.file_block_start").alias("block"))
    starts = cut_lineage(pieces.mapInArrow(block_maps, MAPS).groupBy("file").applyInArrow(compose, STARTS))
    known = lambda k: F.coalesce(c(k), F.raise_error(F.lit("a JSON file changed while it was read"))).alias(k)
    placed = pieces.join(F.broadcast(starts.drop("balanced")), ["file", "block"], "left").select("file", "block", "value", known("quoted"), known("depth"))
    cuts = cut_lineage(placed.mapInArrow(lambda batches: cut_blocks(batches, member), PIECES))

    # Along the blocks of a file: is its start inside the array, and how many elements began before it.
    along = Window.partitionBy("file").orderBy("block")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    begun = cuts.where(c("known") & ~c("last") & (c("n") > 0)).groupBy("file", "block").agg(F.count("*").alias("_known"))
    ends = cuts.where("last").select("file", "block", c("n").alias("_unknown"), "inside").join(begun, ["file", "block"], "left")
    ends = ends.join(starts.select("file", "block", "balanced"), ["file", "block"])
    ends = ends.withColumn("_in", F.coalesce(F.last("inside", ignorenulls=True).over(before), F.lit(False)))
    ends = ends.withColumn("_first", F.when(c("_in"), c("_unknown")).otherwise(0))
    ends = ends.withColumn("_base", F.coalesce(F.sum(c("_first") + F.coalesce("_known", F.lit(0))).over(before), F.lit(0)))
    found = cuts.where(~c("last")).drop("inside").join(ends.where("balanced").select("file", "block", "_in", "_first", "_base"), ["file", "block"])
    found = found.where(c("known") | c("_in")).withColumn("seq", c("_base") + c("n") - 1 + F.when(c("known"), c("_first")).otherwise(0))
    parts = F.array_sort(F.collect_list(F.struct("block", "text")))
    joined = found.where("cut").groupBy("file", "seq").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))
    return found.where(~c("cut")).select("file", "seq", "text").unionByName(joined)
