"""Square patches around polygons, and models applied to them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landwatch.operators.raster import Grid
from landwatch.operators.skew import salted_join
from landwatch.schema import LAND_COVER_CLASSES

c = F.col
REFLECTANCE = 10000.0  # fixed value: stored reflectance of one


def windows(polygons: DataFrame, grid: Grid, x: str, y: str, size: int) -> DataFrame:
    """Patch window of each centre: clamped to the raster, with the offset that centres it."""
    half = size // 2
    r, k = grid.row_at(c(y)), grid.col_at(c(x))
    d = polygons.withColumns({"_r": r, "_k": k})
    cut = lambda v, n: (F.greatest(c(v) - half, F.lit(0)), F.least(c(v) + half, F.lit(n)))
    (r0, r1), (k0, k1) = cut("_r", grid.rows), cut("_k", grid.cols)
    d = d.withColumns({"w_r0": r0, "w_r1": r1, "w_c0": k0, "w_c1": k1})
    off = lambda a, b: F.floor((F.lit(size) - (c(b) - c(a))) / 2).cast("int")
    return d.withColumns({"w_ro": off("w_r0", "w_r1"), "w_co": off("w_c0", "w_c1")}).drop("_r", "_k")


def patch_pixels(polygons: DataFrame, pixels: DataFrame, grid: Grid, key: str, x: str, y: str, size: int, values: list[str]) -> DataFrame:
    """(key, p_row, p_col, values) of the raster pixels inside each patch, joined on patch-sized tiles."""
    w = windows(polygons, grid, x, y, size)
    names = ["w_r0", "w_r1", "w_c0", "w_c1", "w_ro", "w_co"]
    w = w.select(key, *names)
    w = (w.withColumn("_tr", F.explode(F.sequence(F.floor(c("w_r0") / size), F.floor((c("w_r1") - 1) / size))))
         .withColumn("_tc", F.explode(F.sequence(F.floor(c("w_c0") / size), F.floor((c("w_c1") - 1) / size)))))
    p = pixels.select("row_idx", "col_idx", *values).withColumns({"_tr": F.floor(c("row_idx") / size), "_tc": F.floor(c("col_idx") / size)})
    hit = salted_join(w, p, ["_tr", "_tc"], left_id=key).where((c("row_idx") >= c("w_r0")) & (c("row_idx") < c("w_r1")) & (c("col_idx") >= c("w_c0")) & (c("col_idx") < c("w_c1")))
    return hit.select(key, (c("row_idx") - c("w_r0") + c("w_ro")).alias("p_row"), (c("col_idx") - c("w_c0") + c("w_co")).alias("p_col"), *values)


def dense_patches(found: DataFrame, key: str, size: int, values: list[str]) -> DataFrame:
    """One row per patch with a zero-padded array per channel, in row-major order.

    A group is one patch, so it never holds more than size x size pixels.
    """
    schema = T.StructType([found.schema[key], T.StructField("channels", T.ArrayType(T.ArrayType(T.FloatType())))])

    def fill(table: pa.Table) -> pa.Table:
        at = table["p_row"].to_numpy() * size + table["p_col"].to_numpy()
        block = np.zeros((len(values), size * size), dtype=np.float32)
        for i, v in enumerate(values):
            block[i, at] = table[v].cast(pa.float64()).fill_null(0).to_numpy()
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * size * size, pa.int32()), pa.array(block.ravel()))
        return table.slice(0, 1).select([key]).append_column("channels", pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), flat))

    return found.groupBy(key).applyInArrow(fill, schema)


def reflectance(channels: Column) -> Column:
    """Channels divided by the reflectance scale."""
    return F.transform(channels, lambda ch: F.transform(ch, lambda v: (v / REFLECTANCE).cast("float")))


def standardised(channels: Column, means: list[float], stds: list[float]) -> Column:
    """Channels as (v - mean) / std; std 0 leaves a channel alone, channels without statistics become 0.

    Values that are not finite become 0.
    """
    m, s = (F.array(*[F.lit(float(v)) for v in vs]) for vs in (means, stds))

    def one(ch, i):
        mean, std = F.get(m, i), F.get(s, i)
        scaled = lambda v: F.when(std > 0, (v - mean) / std).otherwise(v.cast("double"))
        finite = lambda v: F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(0.0)).otherwise(v)
        return F.transform(ch, lambda v: F.when(mean.isNull(), F.lit(0.0)).otherwise(finite(scaled(v))).cast("float"))

    return F.transform(channels, one)


def softmax(logits: Column) -> Column:
    """Probabilities of class scores."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda v: F.exp((v - top).cast("double")))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, x: a + x))


def sigmoid(logits: Column) -> Column:
    return F.transform(logits, lambda v: 1.0 / (1.0 + F.exp(-v.cast("double"))))


def top_class(probabilities: Column, classes: list[str]) -> dict[str, Column]:
    """Best class (the first of equals), its index and confidence, and the class-to-probability map."""
    names = F.array(*[F.lit(n) for n in classes])
    index = (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int")
    return {"class_index": index, "dominant_class": F.get(names, index), "confidence": F.array_max(probabilities),
            "class_probabilities": F.map_from_arrays(names, probabilities)}


def landslide_verdict(probabilities: Column, threshold: float = 0.5) -> dict[str, Column]:
    """Mean, peak and share above the threshold; a landslide needs a high mean and a high share."""
    n = F.size(probabilities)
    mean = F.aggregate(probabilities, F.lit(0.0), lambda a, v: a + v) / n
    share = F.size(F.filter(probabilities, lambda v: v > threshold)) / n
    return {"landslide_probability": mean, "max_probability": F.array_max(probabilities), "pixel_fraction": share,
            "is_landslide": (mean > threshold * 0.7) & (share > 0.15)}


def apply_model(patches: DataFrame, key: str, load: Callable[[], Callable[[np.ndarray], np.ndarray]], size: int) -> DataFrame:
    """Add logits (flattened per patch) from a model that maps (n, channels, size, size) to scores.

    ``load`` runs once per task and returns the predictor. A batch that fails is retried patch by
    patch, and a patch that fails alone gets null and the error's text in ``model_error``.
    """
    schema = T.StructType([patches.schema[key], T.StructField("logits", T.ArrayType(T.FloatType())), T.StructField("model_error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = load()

        def scores(rows) -> list:
            block = np.stack([np.stack([np.asarray(ch, dtype=np.float32) for ch in p]) for p in rows])
            out = np.asarray(predict(block.reshape(len(rows), block.shape[1], size, size)), dtype=np.float32)
            return list(out.reshape(len(rows), -1))

        def alone(p):
            try:
                return scores([p])[0], None
            except Exception as failed:
                return None, f"{type(failed).__name__}: {failed}"

        for batch in batches:
            rows = list(batch["channels"])
            try:
                result, errors = scores(rows) if rows else [], [None] * len(rows)
            except Exception:
                result, errors = zip(*map(alone, rows))
            yield pd.DataFrame({key: batch[key], "logits": list(result), "model_error": list(errors)})

    return patches.select(key, "channels").mapInPandas(run, schema)


def classify_land_cover(patches: DataFrame, key: str, load, size: int = 64) -> DataFrame:
    """Land-cover class of every patch by a user's model; null where the model fails."""
    scored = apply_model(patches.withColumn("channels", reflectance(c("channels"))), key, load, size)
    p = scored.withColumn("p", softmax(c("logits")))
    return p.withColumns(top_class(c("p"), LAND_COVER_CLASSES)).drop("p", "logits")


def classify_landslides(polygons: DataFrame, patches: DataFrame, key: str, load, means: list[float], stds: list[float],
                        min_slope_deg: float = 10.0, threshold: float = 0.5, size: int = 128) -> DataFrame:
    """Landslide verdict of steep polygons only; the slope test comes before the model sees a patch."""
    steep = polygons.where(c("slope_degree_mean") >= min_slope_deg).select(key)
    ready = patches.join(steep, key, "left_semi").withColumn("channels", standardised(c("channels"), means, stds))
    scored = apply_model(ready, key, load, size).withColumn("p", sigmoid(c("logits")))
    return scored.withColumns(landslide_verdict(c("p"), threshold)).drop("p", "logits")


def refine_types(changes: DataFrame, verdicts: DataFrame, key: str, version: str) -> DataFrame:
    """Changes found to be landslides get that type, the mean probability and the model version."""
    v = verdicts.where("is_landslide").groupBy(key).agg(F.max("landslide_probability").alias("_p"))  # one row a change
    hit = c("_p").isNotNull()
    return changes.join(v, key, "left").withColumns({
        "change_type": F.when(hit, F.lit("LandslideDebris")).otherwise(c("change_type")),
        "ml_confidence": F.when(hit, c("_p")).otherwise(c("ml_confidence")),
        "ml_model_version": F.when(hit, F.lit(version)).otherwise(c("ml_model_version"))}).drop("_p")
