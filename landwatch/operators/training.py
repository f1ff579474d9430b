"""Statistics of labelled patch sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def file_id(path: Column) -> Column:
    """First number in the file name, null when there is none."""
    stem = F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"^(.*?)(\.[^.]*)?$", 1)
    return F.nullif(F.regexp_extract(stem, r"(\d+)", 1), F.lit(""))


def _by_id(files: DataFrame, out: str) -> DataFrame:
    return (files.withColumn("file_id", file_id(c("path"))).where(c("file_id").isNotNull())
            .groupBy("file_id").agg(F.max("path").alias(out)))


def pair_files(images: DataFrame, masks: DataFrame) -> DataFrame:
    """Image and mask paths with the same id in both folders; sort by sample_no for the numeric order."""
    both = _by_id(images, "image_path").join(_by_id(masks, "mask_path"), "file_id")
    return both.withColumn("sample_no", c("file_id").cast("decimal(38,0)").cast("long"))


def unpaired_count(images: DataFrame, masks: DataFrame) -> DataFrame:
    """How many ids appear in one folder only."""
    both = _by_id(images, "image_path").join(_by_id(masks, "mask_path"), "file_id", "full")
    return both.agg(F.count_if(c("image_path").isNull() | c("mask_path").isNull()).alias("unpaired"))


def channel_statistics(values: DataFrame) -> DataFrame:
    """Mean and population standard deviation per channel of (channel, value) rows, std at least 1e-6."""
    return values.groupBy("channel").agg(F.avg("value").alias("mean"),
                                         F.greatest(F.stddev_pop("value"), F.lit(1e-6)).alias("std"))


def channel_rows(patches: DataFrame, channels: str = "channels") -> DataFrame:
    """(channel, value) rows of patches with one array per channel."""
    one = patches.select(F.posexplode(channels).alias("channel", "_values"))
    return one.select("channel", F.explode("_values").alias("value")).withColumn("value", c("value").cast("double"))


def positive_weight(masks: DataFrame, mask: str = "mask", most: float | None = None) -> DataFrame:
    """Negative over positive pixels, at least one positive assumed, optionally capped for training."""
    hits = F.aggregate(c(mask), F.lit(0).cast("long"), lambda a, v: a + v)
    totals = masks.agg(F.sum(hits).alias("positives"), F.sum(F.size(mask)).alias("pixels"))
    w = (c("pixels") - c("positives")) / F.greatest(c("positives"), F.lit(1))
    return totals.withColumn("pos_weight", w if most is None else F.least(w, F.lit(float(most))))


def segmentation_metrics(pairs: DataFrame, predicted: str, target: str, threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1 and IoU of probability arrays against 0/1 arrays over all pixels.

    Each patch counts its own hits first, so only three numbers per task are shuffled.
    """
    flags = F.zip_with(c(predicted), c(target), lambda p, t: F.when((p > threshold) & (t == 1), 1).when(p > threshold, 2).when(t == 1, 3).otherwise(0))
    hits = lambda k: F.sum(F.size(F.filter(c("_f"), lambda v: v == k)).cast("long"))
    total = pairs.select(flags.alias("_f")).agg(hits(1).alias("tp"), hits(2).alias("fp"), hits(3).alias("fn"))
    part = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp = c("tp")
    out = total.withColumns({"precision": part(tp, tp + c("fp")), "recall": part(tp, tp + c("fn")), "iou": part(tp, tp + c("fp") + c("fn"))})
    return out.withColumn("f1", part(c("precision") * c("recall") * 2, c("precision") + c("recall")))


def sample_weights(masks: DataFrame, mask: str = "mask") -> DataFrame:
    """Weight 2 for patches with any positive pixel, else 1."""
    return masks.withColumn("weight", F.when(F.exists(mask, lambda v: v > 0), 2.0).otherwise(1.0))


def weighted_draws(weighted: DataFrame, key: str, seed: int, buckets: int = 512) -> DataFrame:
    """As many draws with replacement as there are patches, each with chance in proportion to its weight.

    A patch owns an interval as long as its weight, any number from 0 on. A draw first takes a hash
    bucket, by an interval join with the few bucket totals, then a patch inside it; there is no global sort.
    """
    b = weighted.where(c("weight") > 0).select(key, c("weight").cast("double").alias("_w"), F.pmod(F.xxhash64(key), F.lit(buckets)).alias("_b"))
    run = Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = b.withColumn("_to", F.sum("_w").over(run))
    totals = b.groupBy("_b").agg(F.sum("_w").alias("_t"))
    edges = totals.agg(F.array_sort(F.collect_list(F.struct("_b", "_t"))).alias("_all"))  # ``buckets`` entries at most
    ends = F.transform(F.sequence(F.lit(1), F.size("_all")), lambda i: F.aggregate(F.slice("_all", F.lit(1), i), F.lit(0.0), lambda s, x: s + x["_t"]))
    edges = edges.select("_all", ends.alias("_ends")).withColumn("_whole", F.element_at("_ends", -1))
    # 53 bits of a hash make a number in [0, 1)
    part = F.shiftrightunsigned(F.xxhash64(c(key), F.lit(seed)), 11) / F.lit(float(1 << 53))
    placed = weighted.crossJoin(F.broadcast(edges)).select(c(key).alias("_k"), (part * c("_whole")).alias("_u"), "_all", "_ends").select(
        "_k", "_u", (F.size(F.filter("_ends", lambda e: e <= c("_u"))) + 1).alias("_i"), "_all", "_ends")
    place = F.least("_i", F.size("_all"))
    draws = placed.select("_k", F.get("_all", place - 1)["_b"].alias("_b"), (c("_u") - F.coalesce(F.get("_ends", place - 2), F.lit(0.0))).alias("_at"))
    # inside a bucket draws and intervals are merged in one order: a draw takes the next interval's end at or after it
    both = draws.select("_b", c("_at").alias("_x"), F.lit(None).cast(weighted.schema[key].dataType).alias(key), F.lit(0).alias("_kind")).unionByName(
        inside.select("_b", c("_to").alias("_x"), key, F.lit(1).alias("_kind")))
    ahead = Window.partitionBy("_b").orderBy(c("_x").desc(), c("_kind").asc())
    last = F.max_by(key, "_x").over(Window.partitionBy("_b"))
    return both.withColumn(key, F.coalesce(F.last(F.when(c("_kind") == 1, c(key)), True).over(ahead.rowsBetween(Window.unboundedPreceding, Window.currentRow)), last)).where(
        "_kind = 0").select(key)
