"""Links between nodes followed to components, in rounds of joins and aggregates with a written table each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landwatch.session import cut_lineage

c = F.col


def roots(links: DataFrame) -> DataFrame:
    """``node, root`` of every node in the long columns ``x, y`` of ``links``; the root is the least node that links lead to.

    Null ends and links of a node with itself say nothing. Repeated links count once; without links the result is empty.
    """
    links = links.where("x <> y").select("x", "y").distinct()
    two_way = cut_lineage(links.unionByName(links.select(c("y").alias("x"), c("x").alias("y"))))
    label = two_way.groupBy(c("x").alias("node")).agg(F.least(c("node"), F.min("y")).alias("root"))
    label = cut_lineage(label)
    if label.isEmpty():
        return label
    while True:
        near = two_way.join(label.select(c("node").alias("y"), c("root").alias("_r")), "y").groupBy("x").agg(F.min("_r").alias("_r"))
        hooked = label.join(near, label["node"] == near["x"]).select("node", "root", F.least("root", "_r").alias("_new"))
        follow = hooked.groupBy("root").agg(F.min("_new").alias("_to"))  # what one node of a label has learnt holds for all of it
        step = hooked.join(follow, "root").select("node", F.least("_new", "_to").alias("_next"), "root")
        # the label of a label: its node has moved down as well
        step = cut_lineage(step)
        higher = step.select(c("node").alias("_next"), c("_next").alias("_top"))
        label = cut_lineage(step.join(higher, "_next").select("node", F.least("_next", "_top").alias("root"), (c("_top") < c("root")).alias("_moved"), (c("_next") < c("root")).alias("_went")))
        moved = label.where("_moved or _went")
        label = label.select("node", "root")
        if moved.isEmpty():
            return label


def relabel(rows: DataFrame, column: str, found: DataFrame) -> DataFrame:
    """``rows`` with ``column`` replaced by its root; nodes without links keep their own."""
    told = found.select(c("node").alias(column), c("root").alias("_root"))
    return rows.join(told, column, "left").select(*(F.coalesce("_root", column).alias(column) if k == column else c(k) for k in rows.columns))
