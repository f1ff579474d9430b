"""Mixing sources to target weights by subset-sum budget fitting.

``targets`` deals a total budget over the sources: shares by weight, each stopped at ``most`` times
its source's size, the excess dealt again by weight until no source is above. ``mix`` then fits each
target: whole repeats of a source first; the remaining budget is fitted on the histogram of exact
document sizes, by equal shares of every size, then larger sizes, then a bounded-knapsack dynamic
programme over the last ``WINDOW`` words. Documents of a size are picked in the order of a seeded hash.

Null sources are one source, the last. Null texts and texts without words have size 0 and are taken
0 times. Repeated rows are documents of their own. A source without words has target 0. An empty
table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landwatch.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
#: Words that the dynamic programme fits exactly.
WINDOW = 1 << 16
BUCKETS = 4096
c = F.col


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size to take, at most ``counts``, for a sum near ``budget`` and not above."""
    total = int((sizes * counts).sum())
    if budget >= total:
        return counts.copy()
    taken = (counts * (budget / total)).astype(np.int64)
    rest = budget - int((sizes * taken).sum())
    order = np.argsort(-sizes)
    for i in order:
        if rest <= WINDOW:
            break
        more = min(int(counts[i] - taken[i]), max(0, (rest - WINDOW // 2) // int(sizes[i])))
        taken[i] += more
        rest -= more * int(sizes[i])
    if rest <= 0:
        return taken
    rest_fit = min(rest, 2 * WINDOW)
    first = np.full(rest_fit + 1, -1, np.int64)
    first[0] = 0
    items: list[tuple[int, int]] = [(0, 0)]
    for i in order:
        size, left = int(sizes[i]), int(counts[i] - taken[i])
        step = 1
        while left > 0 and step * size <= rest_fit:
            n = min(step, left)
            weight = n * size
            if weight <= rest_fit:
                new = np.flatnonzero((first[:rest_fit + 1 - weight] >= 0) & (first[weight:] < 0)) + weight
                items.append((i, n))
                first[new] = len(items) - 1
            left -= n
            step *= 2
        if first[rest_fit] >= 0:
            break
    at = int(np.flatnonzero(first >= 0)[-1])
    while at:
        i, n = items[first[at]]
        taken[i] += n
        at -= n * int(sizes[i])
    return taken


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """``source_key, source_size`` with the weight by order of key and the target; only sums reach the driver."""
    placed = cut_lineage(sizes.orderBy("source_key").withColumn("_at", F.monotonically_increasing_id()))
    pid = F.shiftright("_at", 33)
    before = placed.groupBy(pid.alias("_pid")).count().withColumn(
        "_before", F.sum("count").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
    place = F.coalesce(c("_before"), F.lit(0)) + c("_at").bitwiseAND(F.lit((1 << 33) - 1))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int"))
    weighed = cut_lineage(placed.withColumn("_pid", pid).join(before, "_pid").select(
        "source_key", "source_size", weight.alias("weight"), (c("source_size") * float(most)).alias("cap")))
    budget, free = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    budget, level, capped = budget * share, 0.0, 0
    if free:
        level = budget / free
        while True:
            stop = c("cap") < F.lit(level) * c("weight")
            n, full, free = weighed.agg(F.count(F.when(stop, 1)), F.coalesce(F.sum(F.when(stop, c("cap"))), F.lit(0.0)),
                                        F.coalesce(F.sum(F.when(~stop, c("weight"))), F.lit(0.0))).first()
            if n == capped or not free:
                break
            capped, level = n, (budget - full) / free
    return weighed.withColumn("target", F.least("cap", F.lit(level) * c("weight")))


def mix(docs: DataFrame, ident: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[float, ...] = (5, 2, 1),
        share: float = 1.5, most: int = 2, seed: int = 17) -> DataFrame:
    """One row per document: ``ident, size, source_size, target, taken``; taken is 0 or up to ``most`` times the size."""
    key = F.coalesce(F.concat(F.lit("s"), c(source)), F.lit("t"))  # null sorts last
    sized = cut_lineage(docs.select(c(ident).alias("_id"), key.alias("source_key"), words(c(text)).alias("size")).withColumn(
        "_h", F.xxhash64(F.lit(seed), c("_id"))).withColumn("_b", F.pmod("_h", F.lit(BUCKETS)).cast("int")))
    goal = targets(sized.groupBy("source_key").agg(F.sum("size").alias("source_size")), weights, share, most)
    cells = sized.groupBy("source_key", "size", "_b").agg(F.count("*").alias("_n"))
    bins = cells.groupBy("source_key", "size").agg(F.sum("_n").alias("_n")).join(goal, "source_key")

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("size", ignore_index=True)
        whole, goal_ = int(part.source_size[0]), float(part.target[0])
        base = int(min(most, goal_ // whole)) if whole else 0
        some = (part["size"] > 0).to_numpy()
        extra = np.zeros(len(part), np.int64)
        if whole and base < most:
            extra[some] = fit(part["size"].to_numpy()[some], part["_n"].to_numpy()[some], int(goal_ - base * whole + 1e-6))
        return pd.DataFrame({"source_key": part.source_key, "size": part["size"], "source_size": part.source_size,
                             "target": part.target, "_base": base, "_extra": extra})

    solved = bins.groupBy("source_key").applyInPandas(solve, "source_key string, size long, source_size long, target double, _base long, _extra long")
    earlier = Window.partitionBy("source_key", "size").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    quota = cells.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).join(solved, ["source_key", "size"]).withColumn(
        "_quota", c("_extra") - c("_before")).drop("_n", "_before", "_extra")
    place = F.row_number().over(Window.partitionBy("source_key", "size", "_b").orderBy("_h", "_id"))
    return sized.withColumn("_place", place).join(quota, ["source_key", "size", "_b"]).select(
        c("_id").alias(ident), "size", "source_size", "target",
        (c("size") * (c("_base") + F.when(c("_place") <= c("_quota"), 1).otherwise(0))).alias("taken"))
