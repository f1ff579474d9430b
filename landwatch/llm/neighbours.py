"""Approximate nearest neighbours by largest inner product, with balanced posting lists.

A bounded sample of vectors is split in two by means, again and again, with both halves of a split
kept above a third, until the parts are small: their means are the centroids of the lists. Each vector
goes to its nearest list and, near a border, to further lists whose centroid is not much farther
(replicas). Centroids are searched best-first over an in-memory graph;
a query reads the lists whose distance is within ``probe`` times that of the nearest.

Inner products become distances by one more component that gives every vector the greatest length.
Lists and their queries are cut into blocks of bounded size, each one matrix product; scores of the
best are then computed again in double precision on the original vectors.

Equal vectors are searched once: of equal vectors only the ``k + 1`` of least id can be among the ``k``
nearest of any query, so the others are indexed by them, which loses no answer; every query row still gets its own
result. Vectors that are null, zero, hold null or non-finite components, or differ in length from
most take no part. Rows with the query's id are never its answer. Repeated rows are rows of their
own. An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landwatch.session import cut_lineage

#: Rows that fit the lists, and most lists.
SAMPLE, MOST_LISTS = 50_000, 4096
#: Vectors or queries of one block of a list.
BLOCK = 2048
#: Lists that a query reads first; from the others it takes only what is as near as its k-th of these.
FIRST_LISTS = 8
SALTS = 16
c = F.col


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def lift(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with a component more, all of length ``longest``."""
    return np.hstack([x, np.sqrt(np.maximum(longest**2 - (x * x).sum(axis=1), 0))[:, None]])


def level(q: np.ndarray, longest: float) -> np.ndarray:
    """Queries in the lifted space; their length does not change the order of their answers."""
    return np.hstack([q * (longest / np.sqrt((q * q).sum(axis=1)))[:, None], np.zeros((len(q), 1))])


def split(x: np.ndarray, lists: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids of ``lists`` parts of nearly equal size."""
    parts, done = [np.arange(len(x))], []
    goal = max(1, len(x) // lists)
    while parts:
        rows = parts.pop()
        if len(rows) < 1.5 * goal or len(rows) < 2:
            done.append(x[rows].mean(axis=0))
            continue
        own = x[rows]
        pair = own[rng.choice(len(rows), 2, replace=False)]
        for _ in range(6):
            lean = own @ (pair[0] - pair[1]) - ((pair[0] ** 2).sum() - (pair[1] ** 2).sum()) / 2
            order = np.argsort(lean, kind="stable")
            cut = min(max(int((lean < 0).sum()), len(rows) // 3), len(rows) - len(rows) // 3)
            cut = min(max(cut, 1), len(rows) - 1)
            pair = np.stack([own[order[cut:]].mean(axis=0), own[order[:cut]].mean(axis=0)])
        parts += [rows[order[:cut]], rows[order[cut:]]]
    return np.array(done)


class Graph:
    """Centroids, each linked with its nearest ones and a few others drawn at random."""

    def __init__(self, centroids: np.ndarray, links: int = 24, far: int = 8) -> None:
        self.at = centroids
        self.norm = (centroids**2).sum(axis=1)
        n = len(centroids)
        near = min(links, n)
        rng = np.random.default_rng(5)
        self.links = np.empty((n, near + far), np.int64)
        for i in range(0, n, 512):
            d = self.norm - 2 * centroids[i:i + 512] @ centroids.T
            self.links[i:i + 512, :near] = np.argpartition(d, near - 1, axis=1)[:, :near]
        self.links[:, near:] = rng.integers(0, n, (n, far))
        self.start = rng.permutation(n)[:32]

    def search(self, x: np.ndarray, width: int, ratio: float) -> np.ndarray:
        """Squared distances of each row to the centroids that it met, infinite for others.

        Best-first: the nearest centroid not yet spread from is spread from, while it is among the
        ``width`` nearest met or within ``ratio`` times the nearest.
        """
        n, row = len(x), np.arange(len(x))
        own = (x * x).sum(axis=1)[:, None]
        dist = np.full((n, len(self.at)), np.inf)
        dist[:, self.start] = own + self.norm[self.start] - 2 * x @ self.at[self.start].T
        ahead = dist.copy()  # those not yet spread from
        steps, limit = np.zeros(n, np.int64), np.zeros(n)
        live = row
        while len(live):
            pick = ahead[live].argmin(axis=1)
            near = ahead[live, pick]
            limit[live] = np.minimum(np.where(steps[live] == 0, near, limit[live]), near)
            go = np.isfinite(near) & ((steps[live] < width) | (near <= limit[live] * ratio**2))
            live, pick = live[go], pick[go]
            steps[live] += 1
            ahead[live, pick] = np.inf
            step = self.links[pick]
            at = live[:, None]
            fresh = np.isinf(dist[at, step])
            d = own[live] + self.norm[step] - 2 * (x[live][:, None, :] @ self.at[step].transpose(0, 2, 1))[:, 0]
            r, k = np.nonzero(fresh)
            dist[live[r], step[r, k]] = ahead[live[r], step[r, k]] = d[r, k]
        return np.maximum(dist, 0)


def fit(vectors: DataFrame, vector: str, longest: float, lists: int) -> np.ndarray:
    """Centroids from at most ``SAMPLE`` of the vectors, those of least hash; one task, a bounded sample."""
    sample = vectors.select(c(vector).alias("_v"), F.xxhash64(vector).alias("_h")).orderBy("_h").limit(SAMPLE)

    def run(batches):
        rows = [matrix(b.column("_v")) for b in batches if b.num_rows]
        if rows:
            x = lift(np.vstack(rows), longest)
            made = split(x, min(lists, len(x)), np.random.default_rng(3))
            yield pa.RecordBatch.from_arrays([pa.array([made.shape[1]]), pa.array([made.tobytes()])], names=["wide", "centroids"])

    row = sample.coalesce(1).sortWithinPartitions("_h").mapInArrow(run, "wide long, centroids binary").first()
    return np.frombuffer(bytes(row.centroids)).reshape(-1, row.wide)


def assign(df: DataFrame, vector: str, shared, longest: float, query: bool, ratio: float, least: int, most: int | None, width: int = 16) -> DataFrame:
    """``df`` with a row for each list of a vector (replicas) or of a query (lists to read), in column ``_list``.

    Lists within ``ratio`` times the nearest, ``least`` at least; a vector has ``most`` at most.
    """
    def run(batches):
        graph = Graph(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = (level if query else lift)(matrix(part.column(vector)), longest)
                dist = graph.search(x, width, ratio if query else 1.0)
                keep = dist <= dist.min(axis=1, keepdims=True) * ratio**2 + 1e-12
                few = min(least, dist.shape[1])
                best = np.argpartition(dist, few - 1, axis=1)[:, :few]
                keep[np.arange(len(x))[:, None], best] |= np.isfinite(dist[np.arange(len(x))[:, None], best])
                if most and most < dist.shape[1]:
                    keep &= dist <= np.partition(dist, most - 1, axis=1)[:, most - 1:most]
                row, col = np.nonzero(keep)
                out = part.take(pa.array(row))
                near = min(FIRST_LISTS, dist.shape[1])
                first = dist <= np.partition(dist, near - 1, axis=1)[:, near - 1:near]
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(col.astype(np.int32)), pa.array(first[row, col])], names=[*out.schema.names, "_list", "_first"])

    return df.mapInArrow(run, T.StructType([*df.schema, T.StructField("_list", T.IntegerType()), T.StructField("_first", T.BooleanType())]))


def search(df: DataFrame, is_query, ident: str = "vec_id", vector: str = "embedding", k: int = 20, density: float = 1.0, replicas: int = 2,
           border: float = 1.03, probe: float = 1.12) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest found of every query row.

    There are ``density`` times the root of the number of vectors lists, so that what queries read grows with its power 1.5 at most.
    """
    spark = df.sparkSession
    usable = df.select(c(ident).alias("_id"), c(vector).alias("_v"), is_query.alias("_q")).where(
        c("_id").isNotNull() & c("_v").isNotNull() & F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("_v", lambda x: x != 0))
    usable = cut_lineage(usable)
    wide = usable.groupBy(F.size("_v").alias("wide")).count().orderBy(F.desc("count"), F.desc("wide")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if wide is None:
        return spark.createDataFrame([], schema)
    usable = usable.where(F.size("_v") == wide.wide)
    same = Window.partitionBy("_v").orderBy("_id")
    first = usable.withColumn("_n", F.row_number().over(same)).where(c("_n") <= k + 1)
    vectors = cut_lineage(first.groupBy("_v").agg(F.array_sort(F.collect_list("_id")).alias("_ids")))  # k + 1 ids at most
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    longest, count = vectors.agg(F.max(norm), F.count("*")).first()
    shared = spark.sparkContext.broadcast(fit(vectors, "_v", longest, int(min(MOST_LISTS, max(1, density * count**0.5)))))
    asked = usable.where("_q").groupBy("_v").agg(F.min("_id").alias("_qid"))
    postings = cut_lineage(assign(vectors, "_v", shared, longest, False, border, 1, replicas).drop("_first"))
    reads = cut_lineage(assign(asked, "_v", shared, longest, True, probe, 24, None))

    def product(own: pa.Table, ask: pa.Table) -> pa.Table:
        names, none = ["_qid", "_ids", "score"], pa.table({"_qid": pa.array([], pa.int64()), "_ids": pa.array([], pa.list_(pa.int64())), "score": pa.array([], pa.float64())})
        if not own.num_rows or not ask.num_rows:
            return none
        x, q = matrix(own.column("_v").combine_chunks()), matrix(ask.column("_v").combine_chunks())
        bound = ask.column("_bound").to_numpy()
        rough, most = q @ x.T, min(len(x), 2 * k + 2)
        best = np.argpartition(-rough, most - 1, axis=1)[:, :most]
        score = (q[:, None, :] * x[best]).sum(axis=2)  # in one order of summation wherever the pair meets
        least = own.column("_ids").combine_chunks().cast(pa.list_(pa.int64()))
        head = least.flatten().to_numpy()[np.asarray(least.offsets)[:-1] - least.offsets[0].as_py()]
        order = np.lexsort((head[best], -score), axis=1)[:, :k + 1]
        best, score = np.take_along_axis(best, order, 1), np.take_along_axis(score, order, 1)
        row, col = np.nonzero(score >= bound[:, None])
        return pa.table([ask.column("_qid").combine_chunks().take(pa.array(row)).cast(pa.int64()), least.take(pa.array(best[row, col])), pa.array(score[row, col])], names=names)

    def met(ask: DataFrame) -> DataFrame:
        """The best of each list for each query that reads it, in blocks."""
        blocks = F.ceil(c("count") / BLOCK).cast("int")
        size = postings.groupBy("_list").count().select("_list", blocks.alias("_parts")).join(
            ask.groupBy("_list").count().select("_list", blocks.alias("_turns")), "_list")
        size = F.broadcast(size)  # at most MOST_LISTS rows
        left = postings.join(size, "_list").withColumn("_part", F.pmod(F.xxhash64("_v"), c("_parts")).cast("int")).withColumn(
            "_turn", F.explode(F.sequence(F.lit(0), c("_turns") - 1))).select("_list", "_part", "_turn", "_v", "_ids")
        right = ask.join(size, "_list").withColumn("_turn", F.pmod(F.xxhash64("_v"), c("_turns")).cast("int")).withColumn(
            "_part", F.explode(F.sequence(F.lit(0), c("_parts") - 1))).select("_list", "_part", "_turn", "_v", "_qid", "_bound")
        return left.groupBy("_list", "_part", "_turn").cogroup(right.groupBy("_list", "_part", "_turn")).applyInArrow(product, "_qid long, _ids array<long>, score double")

    def best(rows: DataFrame) -> DataFrame:
        once = rows.groupBy("_qid", "_ids").agg(F.max("score").alias("score"))  # a replica meets a query again
        near = Window.partitionBy("_qid").orderBy(F.desc("score"), F.col("_ids")[0])
        return once.withColumn("_n", F.row_number().over(near)).where(c("_n") <= k + 1)

    first = cut_lineage(best(met(reads.where("_first").withColumn("_bound", F.lit(float("-inf"))))))
    bound = first.groupBy("_qid").agg(F.min("score").alias("_least"), F.count("*").alias("_n"))
    further = reads.where("not _first").join(bound, "_qid").withColumn("_bound", F.when(c("_n") > k, c("_least")).otherwise(F.lit(float("-inf"))))
    top = best(first.select("_qid", "_ids", "score").unionByName(met(further))).select("_qid", "score", F.explode("_ids").alias("vec_id"))
    lists = top.groupBy("_qid").agg(F.array_sort(F.collect_list(F.struct((-c("score")).alias("away"), "vec_id"))).alias("_found"))  # (k + 1)^2 at most
    rows = usable.where("_q").select("_id", "_v")
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int"))
    answers = lists.join(asked, "_qid").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = F.slice(F.filter("_found", lambda s: s["vec_id"] != c("_id")), 1, k)
    return rows.join(answers, ["_v", "_salt"]).select(c("_id").alias("query_id"), F.posexplode(own).alias("_at", "_s")).select(
        c("query_id").cast("long"), (c("_at") + 1).cast("int").alias("rank"), c("_s.vec_id").alias("vec_id"), (-c("_s.away")).alias("score"))
