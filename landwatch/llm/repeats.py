"""Removal of repeated byte strings: Burrows-Wheeler transforms with threshold-bounded interval expansion.

Every window of ``length`` bytes is sent to the key of its least gram, so equal windows meet. Only keys
that occur again are followed up: runs of windows of one key travel with their bytes (contexts) to the
task of the key. There the contexts of many keys form one text; its suffixes are sorted by their first
bytes, and breadth-first backward extension on the transform sets the boundaries between rows by increasing common
prefix, each once, and stops at ``length``: boundaries never set lie between rows that share a window.

Equal contexts are one with a multiplicity. A key with more than ``CROWD`` contexts is salted; the
salts exchange one row for each distinct window, so a window found once in each of two salts is still found.

Null texts count as empty. Equal texts are handled once with their number: each window of a text
that stands twice is repeated. Texts below ``length`` bytes lose nothing. Matches never cross
documents; strings are judged on the input. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landwatch.llm.batches import STEP, flat, packed, slices, unpacked
from landwatch.llm.hashing import U, prefix_sums, ragged, span_hashes
from landwatch.session import cut_lineage

GRAM, CROWD = 48, 2000
#: Bytes of contexts of one transform.
TEXT = 1 << 20
c = F.col


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` neighbours."""
    n = len(x)
    grid = np.full(-(-n // w) * w, ~U(0), U)
    grid[:n] = x
    grid = grid.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - w + 1], ahead[w - 1:n])


def runs(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one key: text, key, first and last window start in the text, and whether windows of the run may be equal."""
    none = np.zeros(0, np.int64)
    w, n = length - GRAM + 1, len(raw)
    size = np.diff(offsets)
    long = np.flatnonzero(size >= length)
    if not len(long):
        return none, none.view(U), none, none, none.astype(bool)
    sums, at = prefix_sums(raw), np.arange(n - GRAM + 1)
    gram = span_hashes(sums, at, at + GRAM)
    least = sliding_min(gram, w)
    step = np.zeros(len(least) + 1, np.int64)
    step[offsets[:-1][long]] += 1
    step[offsets[1:][long] - length + 1] -= 1
    valid = np.cumsum(step)[:-1] > 0
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    last = valid.copy()
    last[:-1] &= ~valid[1:] | (least[1:] != least[:-1])
    s0, s1 = np.flatnonzero(new), np.flatnonzero(last)
    heads = np.flatnonzero(valid & (gram[:len(least)] == least))
    tails = np.flatnonzero(valid & (gram[w - 1:w - 1 + len(least)] == least)) + w - 1
    first = np.append(heads, n)[np.searchsorted(heads, s0)]
    end = np.searchsorted(tails, s1 + w - 1, side="right") - 1
    final = np.where(end >= 0, tails[np.maximum(end, 0)] if len(tails) else -1, -1)
    multi = (first <= s1) & (final >= s0 + w - 1) & (first < final)
    owner = np.searchsorted(offsets, s0, side="right") - 1
    return owner, least[s0], s0 - offsets[owner], s1 - offsets[owner], multi


def suffix_order(text: np.ndarray, reach: int) -> np.ndarray:
    """Suffix starts sorted by their first ``reach`` symbols at least."""
    n, packed = len(text), np.zeros(len(text), np.int64)
    padded = np.concatenate([text.astype(np.int64), np.zeros(7, np.int64)])
    for k in range(7):
        packed = (packed << 9) | padded[k:k + n]
    order = np.argsort(packed, kind="stable")
    key = packed[order]
    h = 7
    rank = np.empty(n, np.int64)
    new = np.concatenate([[True], key[1:] != key[:-1]])
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    while h < reach:
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, n))
        rows = ragged(start[size > 1], size[size > 1])  # rows in groups not yet told apart
        if not len(rows):
            break
        suffix = order[rows]
        follow = np.where(suffix + h < n, rank[np.minimum(suffix + h, n - 1)] + 1, 0)
        both = (rank[suffix] << 32) | follow
        turn = np.argsort(both, kind="stable")
        order[rows] = suffix[turn]
        both = both[turn]
        apart = np.concatenate([[True], both[1:] != both[:-1]])
        new[rows] = apart
        rank[order[rows]] = rows[np.maximum.accumulate(np.where(apart, np.arange(len(rows)), 0))]
        h *= 2
    return order


def repeated(text: np.ndarray, length: int) -> np.ndarray:
    """Starts of the strings of ``length`` symbols that start anywhere else as well; symbol 0 separates."""
    n = len(text)
    order = suffix_order(text, length + 1)
    bwt = text[order - 1]
    turn = np.argsort(bwt, kind="stable")
    step = np.empty(n, np.int64)  # row of the suffix one symbol longer
    step[turn] = np.arange(n)
    same = bwt[turn][1:] == bwt[turn][:-1]
    after, before = np.full(n, n, np.int64), np.full(n, -1, np.int64)  # neighbour rows of the same symbol
    after[turn[:-1][same]] = turn[1:][same]
    before[turn[1:][same]] = turn[:-1][same]
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(length):
        size = high - low
        rows = ragged(low, size)
        first = rows[before[rows] < np.repeat(low, size)]
        last = rows[after[rows] >= np.repeat(high, size)]
        low, high = np.sort(step[first]), np.sort(step[last]) + 1
        fresh = ~known[high]
        low, high = low[fresh], high[fresh]
        known[high] = True
        if not len(low):
            break
    close = np.flatnonzero(~known)
    return order[np.union1d(close, close - 1)]


def judge(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For contexts end to end: context and start of every window, and whether it stands twice.

    Windows whose hash stands once are left out of the transform's text; the transform decides on the rest.
    """
    size = np.diff(offsets)
    context = np.repeat(np.arange(len(size)), size - length + 1)
    start = ragged(offsets[:-1], size - length + 1)
    _, back, times = np.unique(span_hashes(prefix_sums(raw), start, start + length), return_inverse=True, return_counts=True)
    may = times[back] > 1
    twice = np.zeros(len(start), bool)
    if may.any():
        need = np.zeros(len(raw) + 1, np.int64)
        np.add.at(need, start[may], 1)
        np.add.at(need, start[may] + length, -1)
        use = np.cumsum(need)[:-1] > 0
        cut = use.copy()  # a separator wherever a stretch of needed bytes or a context begins
        cut[1:] &= ~use[:-1]
        cut[offsets[:-1]] |= use[offsets[:-1]]
        symbol, at = raw[use].astype(np.int64) + 1, np.flatnonzero(use)
        breaks = np.flatnonzero(cut[use])
        text = np.insert(symbol, breaks, 0)
        place = np.insert(at, breaks, -1)
        text, place = np.append(text, 0), np.append(place, -1)
        hit = place[repeated(text, length)]
        mark = np.zeros(len(raw) + 1, bool)
        mark[hit[hit >= 0]] = True
        twice = mark[start] & may
    return context, start - offsets[context], twice


def _ranges(owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of consecutive numbers of each owner."""
    if not len(at):
        return owner, at, at
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)])
    last = np.append(new[1:], True)
    return owner[new], at[new], at[last]


def _task(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Judge contexts in order of key, whole keys at a time, about ``TEXT`` bytes a transform."""
    names = ["h1", "h2", "s0", "s1", "window", "hot"]

    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        bytes_ = rows.column("bytes").combine_chunks()
        number: dict[bytes, int] = {}
        which = np.array([number.setdefault(b, len(number)) for b in bytes_.to_pylist()])
        times = np.bincount(which)
        head = np.full(len(number), len(which))
        np.minimum.at(head, which, np.arange(len(which)))
        raw, offsets = flat(bytes_.take(pa.array(head)))
        context, start, twice = judge(raw, offsets, length)
        twice |= times[context] > 1
        h1, h2, s0 = (rows.column(k).to_numpy() for k in ("h1", "h2", "s0"))
        own, low, high = _ranges(context[twice], start[twice])
        count = np.bincount(own, minlength=len(number))
        begin = np.cumsum(count) - count
        pick = ragged(begin[which], count[which])
        member = np.repeat(np.arange(len(which)), count[which])
        n = len(member)
        yield pa.RecordBatch.from_arrays([pa.array(h1[member]), pa.array(h2[member]), pa.array(s0[member] + low[pick], pa.int32()), pa.array(s0[member] + high[pick], pa.int32()),
                                          pa.nulls(n, pa.int64()), pa.array(np.zeros(n, bool))], names=names)
        hot = rows.column("hot").to_numpy()[head]
        if hot.any():
            use = np.flatnonzero(hot[context])
            window = span_hashes(prefix_sums(raw), offsets[context[use]] + start[use], offsets[context[use]] + start[use] + length)
            window, one = np.unique(window, return_index=True)
            use = use[one]
            m = head[context[use]]
            at = s0[m] + start[use]
            yield pa.RecordBatch.from_arrays([pa.array(h1[m]), pa.array(h2[m]), pa.array(at, pa.int32()), pa.array(at, pa.int32()), pa.array(window.view(np.int64)), pa.array(np.ones(len(m), bool))], names=names)

    held: list[pa.RecordBatch] = []
    weight = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        for part in slices(batch, "bytes", TEXT // 4):
            held.append(part)
            weight += part.nbytes
            if weight > TEXT:
                rows = pa.Table.from_batches(held)
                key, salt = rows.column("key").to_numpy(), rows.column("salt").to_numpy()
                same = (key == key[-1]) & (salt == salt[-1])
                cut = int(np.argmax(same))
                if cut:
                    yield from work(rows.slice(0, cut))
                    held = rows.slice(cut).combine_chunks().to_batches()
                    weight = sum(x.nbytes for x in held)
    if held:
        yield from work(pa.Table.from_batches(held))


def marked(docs: DataFrame, text: str, length: int) -> DataFrame:
    """``h1, h2, times, spans``: for every distinct text with repeated windows or copies, how often it stands and its runs of repeated window starts."""
    body = docs.select(F.coalesce(c(text), F.lit("")).alias("_text")).where(F.octet_length("_text") >= length).select(
        F.xxhash64("_text").alias("h1"), F.xxhash64(F.lit(1), "_text").alias("h2"), "_text")

    def scan(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                owner, key, s0, s1, multi = runs(*flat(part.column("_text")), length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), part.column("h1").take(pa.array(owner)), pa.array(s0.astype(np.int32)), pa.array(s1.astype(np.int32)),
                     pa.array(np.where(multi, 2, 1).astype(np.int32))], names=["key", "h1", "s0", "s1", "times"])

    found = cut_lineage(body.select("h1", "_text").mapInArrow(scan, "key long, h1 long, s0 int, s1 int, times int"))
    again = found.groupBy("key").agg(F.sum("times").alias("_n")).where(c("_n") > 1).select("key", F.ceil(c("_n") / CROWD).cast("int").alias("salts"))
    lists = found.join(again, "key").groupBy("h1").agg(F.collect_set(F.struct("key", "s0", "s1", "salts")).alias("runs"))  # bounded by the text itself
    texts = packed(body, ["h1", "h2"]).groupBy("h1", "h2").agg(F.first("_packed").alias("_packed"), F.first("_size").alias("_size"))

    def contexts(batches):
        for batch in batches:
            for part in unpacked(batch, 1 << 19):
                raw, offsets = flat(part.column("_text"))
                list_ = part.column("runs")
                count = np.diff(np.asarray(list_.offsets))
                item = list_.flatten()
                key, s0, s1, salts = (item.field(k).to_numpy() for k in ("key", "s0", "s1", "salts"))
                row = np.repeat(np.arange(len(count)), count)
                size = s1 - s0 + length
                ends = np.concatenate([[0], np.cumsum(size)])
                data = raw[ragged(offsets[row] + s0, size.astype(np.int64))]
                out = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
                h1, h2 = part.column("h1").to_numpy()[row], part.column("h2").to_numpy()[row]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array((h2 % salts).astype(np.int32)), pa.array(salts > 1), pa.array(h1), pa.array(h2),
                                                  pa.array(s0.astype(np.int32)), out], names=["key", "salt", "hot", "h1", "h2", "s0", "bytes"])

    sent = texts.join(lists, "h1").mapInArrow(contexts, "key long, salt int, hot boolean, h1 long, h2 long, s0 int, bytes binary")
    parts = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    met = sent.repartition(int(parts), "key", "salt").sortWithinPartitions("key", "salt")
    told = cut_lineage(met.mapInArrow(lambda b: _task(b, length), "h1 long, h2 long, s0 int, s1 int, window long, hot boolean"))
    over = told.where("hot").select("window", "h1", "h2", "s0", "s1")
    shared = over.join(over.groupBy("window").agg(F.count("*").alias("_n")).where(c("_n") > 1), "window").select("h1", "h2", "s0", "s1")
    spans = told.where("not hot").select("h1", "h2", "s0", "s1").unionByName(shared).groupBy("h1", "h2").agg(F.collect_set(F.struct("s0", "s1")).alias("spans"))
    copies = body.groupBy("h1", "h2").agg(F.count("*").alias("times")).where(c("times") > 1)
    return spans.join(copies, ["h1", "h2"], "full")


def strip(docs: DataFrame, ident: str = "doc_id", text: str = "text", length: int = 200) -> DataFrame:
    """``ident, n_bytes, n_removed, n_spans, kept``: the bytes of every text that no repeated string covers, and counts."""
    found = marked(docs, text, length)
    rows = docs.select(c(ident), F.coalesce(c(text), F.lit("")).alias("_text")).withColumn("h1", F.xxhash64("_text")).withColumn("h2", F.xxhash64(F.lit(1), "_text"))
    schema = f"{ident} {docs.schema[ident].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary"

    def run(batches):
        for batch in batches:
            for part in unpacked(batch, STEP):
                raw, offsets = flat(part.column("_text"))
                size = np.diff(offsets)
                removed, spans, kept = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64), []
                for i, (times, runs_) in enumerate(zip(part.column("times").to_pylist(), part.column("spans").to_pylist())):
                    own = raw[offsets[i]:offsets[i + 1]]
                    if times is not None and size[i] >= length:
                        runs_ = [{"s0": 0, "s1": int(size[i]) - length}]
                    if runs_:
                        depth = np.zeros(len(own) + 1, np.int64)
                        for r in runs_:
                            depth[r["s0"]] += 1
                            depth[r["s1"] + length] -= 1
                        gone = np.cumsum(depth)[:-1] > 0
                        removed[i] = gone.sum()
                        spans[i] = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                        own = own[~gone]
                    kept.append(own.tobytes())
                yield pa.RecordBatch.from_arrays([part.column(ident), pa.array(size), pa.array(removed), pa.array(spans), pa.array(kept, pa.binary())],
                                                 names=[ident, "n_bytes", "n_removed", "n_spans", "kept"])

    return packed(rows, [ident, "h1", "h2"]).join(found, ["h1", "h2"], "left").select(ident, "_packed", "_size", "times", "spans").mapInArrow(run, schema)

