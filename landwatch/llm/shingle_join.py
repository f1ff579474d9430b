"""Exact n-gram Jaccard self-join of documents, to components.

Documents with one set of word shingles are one node. The join uses relations between sets:

* A node proposes the node of least number that shares most of its sampled least shingles as its pivot.
  What a node differs from its pivot by (its delta) gives its answers from the pivot's: with
  deltas of weight w, x and y of one pivot link exactly if w(x) + w(y) <= base + (a + b) * shared deltas. Those
  within the base are linked through the pivot without looking at any pair; the others can only link to
  a node with shared deltas, so deltas are joined in place of sets.
* Nodes of different pivots meet in index lists of prefix shingles, rarest first by a count sketch
  over all documents. A list is cut in blocks by size class and pivot; a block is skipped by what
  its positions leave at most, pairs of one pivot are never enumerated.

Only components are asked for, so pairs of one component are not listed. Components are known from the pivots first; then
each list compares every row with a few others at fixed strides, which is linear in the list, and what links is merged;
then all lists are gone through in full, between components only. A list longer than ``CHUNK`` is dealt in pairs of chunks. A pair
must also pass the parities of its sets: 256 bits a set, of which no more can differ than shingles do. What is left is checked
on whole sets. Sets are of 64-bit hashes of shingles.

Texts with fewer words than a shingle are one shingle; null texts and texts without words are empty and
link with nothing. Very long texts are steps of their own, whole. Repeated rows share a node. A null id takes part by its text; a component is
named by its least id that is not null, of equal ids by one of them. A pair exactly at the threshold links. Other columns are ignored, whatever their names.
An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landwatch.llm import filters, linking
from landwatch.llm.batches import STEP, flat, packed, slices, unpacked
from landwatch.llm.hashing import LOWER, U, mix, ragged, word_hashes
from landwatch.session import cut_lineage

#: Counters of the sketch, least shingles sampled of a set, samples that a pivot must share.
SKETCH, SAMPLES, SHARED = 1 << 18, 16, 5
#: Members of a pivot that one task compares, pairs enumerated at once, index rows of one step.
CROWD, PAIRS, ROWS = 2000, 1 << 19, 1 << 16
#: Rows of a list that one task compares with as many others; parities of a set.
CHUNK, PARITIES = 20_000, 256
#: How far apart rows of a list stand that are compared before all others, and how often, so that large groups are components by then.
STRIDES, ROUNDS = (1, 2, 3, 5, 8, 13), 2
#: Rows of a list from which it takes part in the rounds after the first; shorter lists have few pairs for each row anyway.
LONG = 64
#: Shingles of sets that a checking task keeps.
HELD = 1_000_000
c = F.col


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts end to end, and the count of each."""
    word, counts = word_hashes(LOWER[raw], offsets)
    ends = np.cumsum(counts)
    fold = np.zeros(len(word) + words, U)
    padded = np.concatenate([word, np.zeros(words, U)])
    for k in range(words - 1, -1, -1):
        fold = mix(padded[np.minimum(np.arange(len(fold)) + k, len(padded) - 1)] + fold)
    parts, sizes = [], np.zeros(len(counts), np.int64)
    for i, (end, n) in enumerate(zip(ends, counts)):
        if n >= words:
            own = np.sort(fold[end - n:end - words + 1])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif n:
            h = U(0)
            for k in range(end - 1, end - n - 1, -1):
                h = mix(word[k:k + 1] + h)
            own = mix(h + U(n))
        else:
            continue
        parts.append(own)
        sizes[i] = len(own)
    return np.concatenate(parts) if parts else np.zeros(0, U), sizes


def profiles(docs: DataFrame, ident: str, text: str, words: int) -> DataFrame:
    """Per row ``id, n, sig1, sig2, t1, t2, least``; and per task the sketch as ``bucket, times`` arrays."""
    kind = docs.schema[ident].dataType.simpleString()
    schema = f"id {kind}, n long, sig1 long, sig2 long, t1 long, t2 long, least array<long>, bits binary, bucket array<int>, times array<int>"
    names = ["id", "n", "sig1", "sig2", "t1", "t2", "least", "bits", "bucket", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, ident_type = np.zeros(SKETCH, np.int64), None
        for batch in batches:
            for part in slices(batch, "_text", STEP // 2):
                token, size = shingle_sets(*flat(part.column("_text")), words)
                count += np.bincount((token & U(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
                owner = np.repeat(np.arange(len(size)), size)
                some = size > 0
                start = (np.cumsum(size) - size)[some]
                sig = np.zeros((2, len(size)), U)
                if len(start):
                    sig[0, some] = np.add.reduceat(mix(token), start)
                    sig[1, some] = np.bitwise_xor.reduceat(mix(token ^ U(0x5851F42D4C957F2D)), start)
                cell = owner * SAMPLES + (token >> U(60)).astype(np.int64)
                first = np.concatenate([[True], cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, bool)
                ends = np.concatenate([[0], np.cumsum(np.bincount(owner[first], minlength=len(size)))])
                ident_type = part.column("id").type
                odd = np.bincount(owner * PARITIES + ((token >> U(40)) % U(PARITIES)).astype(np.int64), minlength=len(size) * PARITIES) & 1
                bits = np.packbits(odd.astype(np.uint8).reshape(len(size), PARITIES), axis=1)
                none = pa.nulls(len(size), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(size), *(pa.array(s.view(np.int64)) for s in sig), part.column("t1"), part.column("t2"),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(token[first].view(np.int64))), pa.array([x.tobytes() for x in bits], pa.binary()), none, none], names=names)
        if ident_type is not None:
            full = np.flatnonzero(count)
            for at in range(0, len(full), 8192):
                part = full[at:at + 8192]
                rest = [pa.nulls(1, t) for t in (ident_type, *[pa.int64()] * 5, pa.list_(pa.int64()), pa.binary())]
                yield pa.RecordBatch.from_arrays([*rest, pa.array([part.astype(np.int32)], pa.list_(pa.int32())), pa.array([count[part].astype(np.int32)], pa.list_(pa.int32()))], names=names)

    return keyed(docs.select(c(ident).alias("id"), F.coalesce(c(text), F.lit("")).alias("_text"))).mapInArrow(run, schema)


def keyed(texts: DataFrame) -> DataFrame:
    return texts.withColumn("t1", F.xxhash64("_text")).withColumn("t2", F.xxhash64(F.lit(1), "_text"))


def pivots(nodes: DataFrame) -> DataFrame:
    """``node, pivot`` of the nodes that share enough least shingles with a node of lower number."""
    least = nodes.select("node", F.explode("least").alias("_m"))
    heads = least.groupBy("_m").agg(F.min("node").alias("pivot"), F.count("*").alias("_n")).where(c("_n") > 1).drop("_n")
    votes = least.join(heads, "_m").groupBy("node", "pivot").agg(F.count("*").alias("_n"))
    best = votes.groupBy("node").agg(F.max(F.struct("_n", -c("pivot"))).alias("_b")).select("node", c("_b._n").alias("_n"), (-c("_b.col2")).alias("pivot"))
    return best.where((c("pivot") != c("node")) & (c("_n") >= SHARED)).select("node", "pivot")


def _ordered(token: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Rarest first by the sketch, then by value."""
    return token[np.lexsort((token, sketch[(token & U(SKETCH - 1)).astype(np.int64)]))]


def prefix(token: np.ndarray, sketch: np.ndarray, a: int, b: int) -> np.ndarray:
    n = len(token)
    keep = n - -(-a * n // b) + 1
    rare = sketch[(token & U(SKETCH - 1)).astype(np.int64)]
    if keep < n:
        limit = np.partition(rare, keep - 1)[keep - 1]
        few = rare <= limit
        token, rare = token[few], rare[few]
    return token[np.lexsort((token, rare))][:keep]


def allowed(rows: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, a: int, b: int) -> np.ndarray:
    """Whether rows x and y of one list may link: by what their positions leave, their labels, components, chunks and parities."""
    left, weight = rows["size"] - rows["pos"], rows["weight"]
    ok = (a + b) * np.minimum(left[x], left[y]) + rows["base"][x] >= weight[x] + weight[y]
    ok &= (rows["label"][x] != rows["label"][y]) & (rows["comp"][x] != rows["comp"][y])
    side = rows["side"]
    ok &= (side[x] == 0) | (side[x] != side[y])
    if "bits" in rows:
        spot = np.flatnonzero(ok)
        differ = np.bitwise_count(rows["bits"][x[spot]] ^ rows["bits"][y[spot]]).sum(axis=1, dtype=np.int64)
        ok[spot] = (a + b) * differ <= (b - a) * (rows["n"][x[spot]] + rows["n"][y[spot]])
    return ok


def enumerate_pairs(rows: dict[str, np.ndarray], a: int, b: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs of complete index lists; rows of one component never meet."""
    order = np.lexsort((rows["comp"], rows["blk"], rows["key"]))
    rows = {k: v[order] for k, v in rows.items()}
    key, blk, size, weight, base = (rows[k] for k in ("key", "blk", "size", "weight", "base"))
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (blk[1:] != blk[:-1])])
    run = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(key))
    _, code = np.unique(rows["comp"], return_inverse=True)
    comp = run * (int(code.max()) + 1) + code
    left = size - rows["pos"]  # tokens from here on, this one included
    most_left, least_weight = np.maximum.reduceat(left, starts), np.minimum.reduceat(weight, starts)
    row = np.arange(len(key))

    def possible(at, block):  # what the best position and the least weight of a block allow
        return (a + b) * np.minimum(left[at], most_left[block]) + base[at] >= weight[at] + least_weight[block]

    spans = []
    at = row[possible(row, run)]
    spans.append((at, np.searchsorted(comp, comp[at], side="right"), ends[run[at]]))
    head = starts[run]
    before = (run > 0) & (key == key[np.maximum(head - 1, 0)]) & (blk == blk[np.maximum(head - 1, 0)] + 1)
    at = row[before]
    at = at[possible(at, run[at] - 1)]
    target = comp[at] - (int(code.max()) + 1)
    spans.append((at, starts[run[at] - 1], np.searchsorted(comp, target)))
    spans.append((at, np.searchsorted(comp, target, side="right"), ends[run[at] - 1]))
    for at, lo, hi in spans:
        count = np.maximum(hi - lo, 0)
        use = count > 0
        at, lo, count = at[use], lo[use], count[use]
        total = np.cumsum(count)
        done = 0
        while done < len(at):
            to = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + PAIRS, side="right")))
            x = np.repeat(at[done:to], count[done:to])
            y = ragged(lo[done:to], count[done:to])
            ok = allowed(rows, x, y, a, b)
            x, y = rows["node"][x[ok]], rows["node"][y[ok]]
            yield np.minimum(x, y), np.maximum(x, y)
            done = to


def _columns(batch: pa.RecordBatch, a: int) -> dict[str, np.ndarray]:
    """The rows of a batch as arrays; a missing label or component is the node itself."""
    whole = lambda k: batch.column(k).to_numpy().astype(np.int64)
    rows = {k: whole(k) for k in ("key", "blk", "node", "pos", "size")}
    rows["label"] = batch.column("label").fill_null(-1).to_numpy()
    rows["label"] = np.where(rows["label"] < 0, rows["node"], rows["label"])
    rows["weight"] = batch.column("weight").fill_null(-1).to_numpy().astype(np.int64)
    rows["weight"] = np.where(rows["weight"] < 0, a * rows["size"], rows["weight"])
    rows["base"] = batch.column("base").fill_null(0).to_numpy().astype(np.int64)
    names = batch.schema.names
    rows["comp"] = whole("comp") if "comp" in names else rows["label"]
    rows["side"] = whole("side") if "side" in names else np.zeros(len(rows["key"]), np.int64)
    if "bits" in names:
        rows["n"] = whole("n")
        rows["bits"] = flat(batch.column("bits"))[0].reshape(-1, PARITIES // 8).view(U)
    return rows


def _told(pairs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    if pairs:
        both = np.unique(np.concatenate(pairs), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["x", "y"])


def _lists(batches: Iterator[pa.RecordBatch], a: int, b: int) -> Iterator[pa.RecordBatch]:
    """Candidates from index rows sorted by key, list after list; a list is whole before it is gone through, once."""
    waiting: list[dict[str, np.ndarray]] = []
    n = 0

    def found(rows):
        if len(rows["key"]):
            pairs = [np.unique(np.stack(pair, axis=1), axis=0) for pair in enumerate_pairs(rows, a, b) if len(pair[0])]
            yield from _told(pairs)

    for batch in batches:
        if batch.num_rows:
            waiting.append(_columns(batch, a))
            n += batch.num_rows
        if n >= ROWS:
            rows = {k: np.concatenate([w[k] for w in waiting]) for k in waiting[0]}
            cut = int(np.searchsorted(rows["key"], rows["key"][-1]))  # the last list may go on
            yield from found({k: v[:cut] for k, v in rows.items()})
            waiting = [{k: v[cut:] for k, v in rows.items()}]
            n = 0
    if waiting:
        yield from found({k: np.concatenate([w[k] for w in waiting]) for k in waiting[0]})


def _steps(batches: Iterator[pa.RecordBatch], a: int, b: int) -> Iterator[pa.RecordBatch]:
    """Candidates of rows that stand a few ``STRIDES`` apart in index rows sorted by key, block and any order: linear in the list."""
    last: dict[str, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = _columns(batch, a)
        if last is not None:
            rows = {k: np.concatenate([last[k], v]) for k, v in rows.items()}
        before = len(last["key"]) if last is not None else 0
        last = {k: v[-max(STRIDES):] for k, v in rows.items()}
        pairs = []
        for stride in STRIDES:
            y = np.arange(max(before, stride), len(rows["key"]))
            x = y - stride
            near = (rows["key"][x] == rows["key"][y]) & (rows["blk"][y] - rows["blk"][x] <= 1)
            x, y = x[near], y[near]
            ok = allowed(rows, x, y, a, b)
            p, q = rows["node"][x[ok]], rows["node"][y[ok]]
            if len(p):
                pairs.append(np.stack([np.minimum(p, q), np.maximum(p, q)], axis=1))
        yield from _told(pairs)


def _alive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and label those of lists with several labels. Of a list whose first label goes on over ``ROWS`` rows all are kept."""
    held: list[pa.RecordBatch] = []
    size, key_, label_, known = 0, None, None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        key, label = batch.column("key").to_numpy(), batch.column("label").to_numpy()
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        end = np.append(start[1:], len(key))
        several = label[start] != label[end - 1]
        if key_ == key[0]:
            several[0] |= known or label_ != label[0]
            if several[0]:
                yield from held
                held, size = [], 0
        else:
            held, size = [], 0
        first, key_, label_, known = start[-1], key[-1], label[-1], bool(several[-1])
        keep = np.repeat(several, end - start)
        if not known:
            held.append(batch.slice(first))
            size += len(key) - first
            if size > ROWS:
                yield from held
                held, size, known = [], 0, True
        if keep.any():
            yield batch.filter(pa.array(keep))


INDEX = "key long, blk int, node long, label long, pos int, size int, weight int, base int"


def _index(key, blk, node, label, pos, size, weight=None, base=None) -> pa.RecordBatch:
    n = len(key)
    make = lambda x, t: pa.nulls(n, t) if x is None else pa.array(np.broadcast_to(np.asarray(x), n), t)
    return pa.RecordBatch.from_arrays(
        [pa.array(key.view(np.int64)), make(blk, pa.int32()), make(node, pa.int64()), make(label, pa.int64()), make(pos, pa.int32()), make(size, pa.int32()),
         make(weight, pa.int32()), make(base, pa.int32())], names=["key", "blk", "node", "label", "pos", "size", "weight", "base"])


def _merge(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _prefix_rows(tokens: list[np.ndarray], nodes, labels, sketch, a, b) -> list[pa.RecordBatch]:
    """Index rows of whole sets, one array a column for all of them."""
    found = [prefix(t, sketch, a, b) for t in tokens]
    count = np.array([len(f) for f in found])
    size = np.repeat([len(t) for t in tokens], count)
    blk = np.floor(np.log(size) / np.log(b / a) + 1e-9).astype(np.int32) if len(size) else size
    label = np.repeat([-1 if x is None else x for x in labels], count)
    batch = _index(np.concatenate(found), blk, np.repeat(np.array(nodes, np.int64), count), label, ragged(np.zeros(len(count), np.int64), count), size)
    return [batch]


def components(docs: DataFrame, ident: str = "doc_id", text: str = "text", words: int = 3, threshold: tuple[int, int] = (9, 10)) -> DataFrame:
    """``ident, n_shingles, component_id`` of every row; documents link at a Jaccard likeness of ``threshold`` (a / b) or more."""
    a, b = threshold
    spark = docs.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = cut_lineage(profiles(docs, ident, text, words))
    rows = found.where("n is not null").select("id", "n", "sig1", "sig2")
    sketch = np.zeros(SKETCH, np.int64)
    totals = found.where("bucket is not null").select(F.explode(F.arrays_zip("bucket", "times")).alias("_e")).groupBy("_e.bucket").agg(F.sum("_e.times").alias("n"))
    for row in totals.toLocalIterator():  # SKETCH rows at most
        sketch[row.bucket] = row.n
    shared = spark.sparkContext.broadcast(sketch)
    nodes = cut_lineage(found.where("n > 0").groupBy("sig1", "sig2", "n").agg(
        F.min("id").alias("least_id"), F.min(F.struct("t1", "t2")).alias("_t"), F.first("least").alias("least"), F.first("bits").alias("bits")).select(
        F.monotonically_increasing_id().alias("node"), "sig1", "sig2", "n", "least_id", "_t.t1", "_t.t2", "least", "bits"))
    pivot = cut_lineage(pivots(nodes))
    crowd = pivot.groupBy("pivot").agg(F.ceil(F.count("*") / CROWD).cast("int").alias("salts"))
    # where each set goes: 0 a pivot to its members' tasks, 1 a member to its pivot's, 2 a set on its own
    member = pivot.join(crowd, "pivot").select("node", c("pivot").alias("to"), F.pmod(F.xxhash64("node"), c("salts")).cast("int").alias("salt"), F.lit(1).alias("role"))
    centre = crowd.select(c("pivot").alias("node"), c("pivot").alias("to"), F.explode(F.sequence(F.lit(0), c("salts") - 1)).alias("salt"), F.lit(0).alias("role"))
    alone = nodes.select("node").join(pivot, "node", "left_anti").select("node", F.lit(None).cast("long").alias("to"), F.lit(0).alias("salt"), F.lit(2).alias("role"))
    ways = member.unionByName(centre).unionByName(alone).groupBy("node").agg(F.collect_list(F.struct("to", "salt", "role")).alias("ways"))
    route = nodes.select("node", "t1", "t2").join(ways, "node")
    body = keyed(docs.select(F.coalesce(c(text), F.lit("")).alias("_text")))
    texts = packed(body, ["t1", "t2"]).groupBy("t1", "t2").agg(F.first("_packed").alias("_packed"), F.first("_size").alias("_size"))

    def sets(batches):
        count = shared.value
        for batch in batches:
            for part in unpacked(batch, STEP // 2):
                token, size = shingle_sets(*flat(part.column("_text")), words)
                ends = np.cumsum(size)
                solo, solo_nodes, kept = [], [], []
                for node, ways_, end, n in zip(part.column("node").to_pylist(), part.column("ways").to_pylist(), ends, size):
                    own = token[end - n:end]
                    for way in ways_:
                        if way["role"] == 2:
                            solo.append(own)
                            solo_nodes.append(node)
                        else:
                            kept.append((way["to"], way["salt"], way["role"], node, own.tobytes()))
                if solo:
                    for x in _prefix_rows(solo, solo_nodes, [None] * len(solo), count, a, b):
                        yield pa.RecordBatch.from_arrays([*x.columns, *(pa.nulls(x.num_rows, t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=[*x.schema.names, "to", "salt", "role", "tokens"])
                if kept:
                    to, salt, role, node, raw = zip(*kept)
                    n = len(kept)
                    yield pa.RecordBatch.from_arrays(
                        [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.array(node, pa.int64()), *(pa.nulls(n, t) for t in (pa.int64(), *[pa.int32()] * 4)),
                         pa.array(to, pa.int64()), pa.array(salt, pa.int32()), pa.array(role, pa.int32()), pa.array(raw, pa.binary())],
                        names=["key", "blk", "node", "label", "pos", "size", "weight", "base", "to", "salt", "role", "tokens"])

    made = cut_lineage(texts.join(route, ["t1", "t2"]).select("node", "ways", "_packed", "_size").mapInArrow(sets, INDEX + ", to long, salt int, role int, tokens binary"))
    index = [k.split()[0] for k in INDEX.split(", ")]

    def deltas(batches):
        count, at, centre_ = shared.value, None, np.zeros(0, U)
        for batch in batches:
            out, links = [], []
            whole, whole_nodes, whole_labels = [], [], []
            for to, salt, role, node, raw in zip(*(batch.column(k).to_pylist() for k in ("to", "salt", "role", "node", "tokens"))):
                own = np.frombuffer(raw, U)
                if role == 0:
                    at, centre_ = (to, salt), own
                    continue
                assert at == (to, salt), "a member before its pivot"
                whole.append(own)
                whole_nodes.append(node)
                whole_labels.append(to)
                both = np.intersect1d(own, centre_, assume_unique=True)
                plus, minus = np.setdiff1d(own, both, assume_unique=True), np.setdiff1d(centre_, both, assume_unique=True)
                weight, base = b * len(minus) + a * len(plus), (b - a) * len(centre_)
                near = weight <= base
                if near:
                    links.append((to, node))
                n = len(plus) + len(minus)
                need = -(-(weight + 1) // (a + b)) if near else max(1, -(-(weight - base) // b))
                keep = n - need + 1
                if keep > 0:
                    turned = [_ordered(plus, count), _ordered(minus, count)]
                    key = mix(np.concatenate([turned[0], mix(turned[1] ^ U(0xD1342543DE82EF95))]) + mix(np.array([to], np.int64).view(U)))[:keep]
                    out.append(_index(key, 0, node, to if near else node, np.arange(len(key)), n, weight, base))
            if whole:
                out += _prefix_rows(whole, whole_nodes, whole_labels, count, a, b)
            if out:
                x = _merge(out)
                yield pa.RecordBatch.from_arrays([*x.columns, pa.nulls(x.num_rows, pa.int64()), pa.nulls(x.num_rows, pa.int64())], names=[*index, "x", "y"])
            if links:
                x, y = zip(*links)
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(x), t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.int32()] * 4)), pa.array(x), pa.array(y)], names=[*index, "x", "y"])

    clustered = made.where("role is not null").select("to", "salt", "role", "node", "tokens").repartition(width, "to", "salt").sortWithinPartitions("to", "salt", "role")
    derived = cut_lineage(clustered.mapInArrow(deltas, INDEX + ", x long, y long"))
    parent = derived.where("x is not null").select(c("y").alias("node"), c("x").alias("up"))  # up < node
    entries = made.where("key is not null").select(*index).unionByName(derived.where("key is not null").select(*index)).withColumn("label", F.when(c("label") >= 0, c("label")).otherwise(c("node")))
    alive = cut_lineage(entries.repartition(width, "key").sortWithinPartitions("key", "label").mapInArrow(_alive, INDEX))
    alive = cut_lineage(alive.join(nodes.select("node", "n", "bits"), "node"))
    root = cut_lineage(followed(parent, nodes))
    long = cut_lineage(alive.groupBy("key").agg(F.count("*").alias("_n")).where(c("_n") > LONG))
    for turn in range(ROUNDS):  # in another order each time, after the first only what long lists still hold apart
        if turn and long.isEmpty():
            break
        rest = alive.join(long, "key", "left_semi") if turn else alive
        met = with_roots(rest, root).withColumn("_order", F.xxhash64("node", F.lit(turn))).repartition(width, "key").sortWithinPartitions("key", "blk", "_order")
        root = merged(met.mapInArrow(lambda x: _steps(x, a, b), "x long, y long").distinct(), root, nodes, body, words, a, b)
    met = in_chunks(with_roots(alive, root), long).repartition(width, "key").sortWithinPartitions("key")
    root = merged(met.mapInArrow(lambda x: _lists(x, a, b), "x long, y long").distinct(), root, nodes, body, words, a, b)
    return named(rows, nodes, root, ident)


def followed(parent: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, root`` of every node by the pivots; pointers go to lower nodes, so each round halves the way."""
    up = cut_lineage(parent)
    while True:
        higher = up.select(c("node").alias("up"), c("up").alias("_top"))
        step = cut_lineage(up.join(higher, "up", "left").select("node", F.coalesce("_top", "up").alias("up"), c("_top").isNotNull().alias("_moved")))
        up = step.select("node", "up")
        if step.where("_moved").isEmpty():
            break
    return nodes.select("node").join(up, "node", "left").select("node", F.coalesce("up", "node").alias("root"))


def with_roots(alive: DataFrame, root: DataFrame) -> DataFrame:
    """Rows with their component; only nodes that have moved are looked up."""
    moved = root.where("root <> node").select("node", c("root").alias("comp"))
    return alive.join(moved, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def in_chunks(rows: DataFrame, long: DataFrame) -> DataFrame:
    """Lists of more than ``CHUNK`` rows as pairs of their chunks, each a list of its own; rows of one side of a pair do not meet.

    ``long`` has the keys of lists with more than ``LONG`` rows and their counts.
    """
    most = long.where(c("_n") > CHUNK).select("key", F.ceil(c("_n") / CHUNK).cast("int").alias("_k"))
    cut = rows.join(most, "key", "left").withColumn("_own", F.when(c("_k").isNotNull(), F.pmod(F.xxhash64("node"), c("_k")).cast("int")))
    cut = cut.withColumn("_other", F.explode(F.when(c("_k").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), c("_k") - 1))))
    dealt = F.xxhash64("key", F.least("_own", "_other"), F.greatest("_own", "_other"))
    side = F.when(c("_k").isNull() | (c("_own") == c("_other")), 0).when(c("_own") < c("_other"), 1).otherwise(2)
    return cut.withColumn("side", side).withColumn("key", F.when(c("_k").isNull(), c("key")).otherwise(dealt)).drop("_k", "_own", "_other")


def merged(pairs: DataFrame, root: DataFrame, nodes: DataFrame, body: DataFrame, words: int, a: int, b: int) -> DataFrame:
    """``node, root`` after the candidate pairs that link have joined their components."""
    links = verified(cut_lineage(pairs), nodes, body, words, a, b)
    for side in ("x", "y"):
        links = linking.relabel(links, side, root)
    return cut_lineage(linking.relabel(root, "root", linking.roots(links)))


def verified(pairs: DataFrame, nodes: DataFrame, body: DataFrame, words: int, a: int, b: int) -> DataFrame:
    """The candidate pairs that link, by whole sets; only texts of candidates are shuffled, compressed."""
    asked = pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct()
    involved = cut_lineage(nodes.select("node", "t1", "t2").join(asked, "node", "left_semi"))
    mask = body.sparkSession.sparkContext.broadcast(filters.build(involved, "t1"))

    some = packed(body, ["t1", "t2"], lambda batch: filters.held(mask.value, batch.column("t1").to_numpy()))
    texts = some.groupBy("t1", "t2").agg(F.first("_packed").alias("_packed"), F.first("_size").alias("_size"))
    held = cut_lineage(texts.join(involved, ["t1", "t2"]).select("node", F.struct("_packed", "_size").alias("_t")))

    def check(batches):
        codec = pa.Codec("zstd")
        kept: dict[int, np.ndarray] = {}
        weight = 0

        def tokens(node, packed_, size, i):
            nonlocal weight
            if node not in kept:
                if weight > HELD:
                    kept.clear()
                    weight = 0
                raw = np.frombuffer(codec.decompress(packed_[i].as_buffer(), int(size[i]), asbytes=True), np.uint8)
                kept[node] = shingle_sets(raw, np.array([0, len(raw)]), words)[0]
                weight += len(kept[node])
            return kept[node]

        for batch in batches:
            linked = []
            sides = [(batch.column(k).field("_packed"), batch.column(k).field("_size").to_numpy()) for k in ("_x", "_y")]
            for i, (x, y) in enumerate(zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())):
                own, other = tokens(x, *sides[0], i), tokens(y, *sides[1], i)
                both = np.sort(np.concatenate([own, other]))
                if (a + b) * int((both[1:] == both[:-1]).sum()) >= a * (len(own) + len(other)):
                    linked.append((x, y))
            x, y = zip(*linked) if linked else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["x", "y"])

    one = pairs.join(held.select(c("node").alias("x"), c("_t").alias("_x")), "x")
    both = one.join(held.select(c("node").alias("y"), c("_t").alias("_y")), "y")
    return both.select("x", "y", "_x", "_y").mapInArrow(check, "x long, y long")


def named(rows: DataFrame, nodes: DataFrame, root: DataFrame, ident: str) -> DataFrame:
    """Give every row the least id of its component."""
    placed = cut_lineage(nodes.select("node", "sig1", "sig2", "n", "least_id").join(root, "node").select("sig1", "sig2", "n", "root", "least_id"))
    least = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named_ = placed.join(least, "root").select("sig1", "sig2", "n", "component_id")
    out = rows.join(named_, ["sig1", "sig2", "n"], "left")
    return out.select(c("id").alias(ident), c("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
