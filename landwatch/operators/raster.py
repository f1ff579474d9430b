"""Pixel tables: bands, index rasters, differences, resampling and composites.

A pixel table has raster keys (scene, run, area ...), row_idx, col_idx and values. All work is a
scan, an equi-join on the pixel or an aggregate with map-side combine.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landwatch.functions.change import changed, ndvi

c = F.col


@dataclass(frozen=True)
class Grid:
    """Corner of the first pixel, signed pixel size and raster shape."""

    x0: float
    y0: float
    dx: float
    dy: float
    rows: int
    cols: int

    def col_at(self, x: Column) -> Column:
        """Column under a position, moved to the nearest one when outside."""
        return F.least(F.greatest(F.floor((x - self.x0) / self.dx), F.lit(0)), F.lit(self.cols - 1)).cast("int")

    def row_at(self, y: Column) -> Column:
        return F.least(F.greatest(F.floor((y - self.y0) / self.dy), F.lit(0)), F.lit(self.rows - 1)).cast("int")

    def center_x(self, col: Column) -> Column:
        return (col + 0.5) * self.dx + self.x0

    def center_y(self, row: Column) -> Column:
        return (row + 0.5) * self.dy + self.y0

    def holds(self, x: Column, y: Column) -> Column:
        """Whether a position lies on the raster."""
        col, row = (x - self.x0) / self.dx, (y - self.y0) / self.dy
        return (col >= 0) & (col < self.cols) & (row >= 0) & (row < self.rows)


def clip(pixels: DataFrame, grid: Grid, box: tuple[float, float, float, float]) -> DataFrame:
    """Pixels whose centre lies in a box, as row and column ranges the scan can use.

    A box off the raster keeps everything, as a failed clip does.
    """
    lo_x, hi_x = sorted(((box[0] - grid.x0) / grid.dx, (box[2] - grid.x0) / grid.dx))
    lo_y, hi_y = sorted(((box[1] - grid.y0) / grid.dy, (box[3] - grid.y0) / grid.dy))
    if hi_x < 0 or lo_x > grid.cols or hi_y < 0 or lo_y > grid.rows:
        return pixels
    ceil = lambda v: int(-(-(v - 0.5) // 1))
    floor = lambda v: int((v - 0.5) // 1)
    return pixels.where(c("col_idx").between(ceil(lo_x), floor(hi_x)) & c("row_idx").between(ceil(lo_y), floor(hi_y)))


def select_bands(bands: DataFrame, wanted: list[str]) -> DataFrame:
    """Rows of the wanted bands; bands a scene lacks are simply absent."""
    return bands.where(c("band").isin(wanted))


def write_bands(bands: DataFrame, path: str) -> None:
    """Band rows under scene and band folders, ordered by tile so that scans can skip."""
    (bands.repartition("scene_id", "band", F.floor(c("row_idx") / 256), F.floor(c("col_idx") / 256))
     .sortWithinPartitions("scene_id", "band", "row_idx", "col_idx")
     .write.mode("overwrite").partitionBy("scene_id", "band").parquet(path))


def write_change_rasters(diff: DataFrame, path: str, keys: list[str]) -> None:
    """Difference and mask rows per raster; the mask is one byte."""
    (diff.withColumn("changed", c("changed").cast("tinyint"))
     .write.mode("overwrite").partitionBy(*keys).parquet(path))


def band_columns(bands: DataFrame, keys: list[str], wanted: list[str]) -> DataFrame:
    """One row per pixel with one column per band, null where a band is missing."""
    return bands.where(c("band").isin(wanted)).groupBy(*keys, "row_idx", "col_idx").agg(
        *[F.max(F.when(c("band") == b, c("value"))).alias(b) for b in wanted])


def scene_ndvi(bands: DataFrame, keys: list[str], nodata: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(index per pixel, rasters that lack the red or near-infrared band with an error)."""
    wide = band_columns(bands, keys, ["B04", "B08"])
    good = wide.where(c("B04").isNotNull() & c("B08").isNotNull()).select(
        *keys, "row_idx", "col_idx", ndvi(c("B04"), c("B08"), nodata).alias("ndvi"))
    have = bands.groupBy(*keys).agg(F.bool_or(c("band") == "B04").alias("_r"), F.bool_or(c("band") == "B08").alias("_n"))
    bad = have.where(~(c("_r") & c("_n"))).select(*keys, F.lit("Scene missing required bands (B04, B08)").alias("error"))
    return good, bad


def ndvi_statistics(ndvi_pixels: DataFrame, keys: list[str], value: str = "ndvi", nodata: float = 0.0) -> DataFrame:
    """Minimum, maximum and mean of valid pixels; (-1, 1, 0) when none is valid."""
    v = F.when((c(value) != nodata) & ~F.isnan(c(value)), c(value).cast("double"))
    return ndvi_pixels.groupBy(*keys).agg(
        F.coalesce(F.min(v), F.lit(-1.0)).alias("min_value"), F.coalesce(F.max(v), F.lit(1.0)).alias("max_value"),
        F.coalesce(F.avg(v), F.lit(0.0)).alias("mean_value"))


def difference(before: DataFrame, after: DataFrame, keys: list[str], threshold: float = -0.2) -> DataFrame:
    """After minus before on pixels both have, and the change mask."""
    on = [*keys, "row_idx", "col_idx"]
    joined = before.select(*on, c("ndvi").alias("_b")).join(after.select(*on, c("ndvi").alias("_a")), on)
    diff = joined.withColumn("ndvi_diff", c("_a") - c("_b"))
    return diff.select(*on, "ndvi_diff", changed(c("ndvi_diff"), threshold).alias("changed"))


def paired_difference(bands: DataFrame, keys: list[str], threshold: float = -0.2, nodata: float = 0.0) -> DataFrame:
    """Difference and mask straight from before and after band rows (column side), in one shuffle.

    Equals scene_ndvi of both sides followed by difference: pixels that lack a band on a side drop out.
    """
    pick = lambda side, b: F.max(F.when((c("side") == side) & (c("band") == b), c("value")))
    wide = bands.where(c("band").isin("B04", "B08") & c("side").isin("before", "after")).groupBy(*keys, "row_idx", "col_idx").agg(
        pick("before", "B04").alias("_rb"), pick("before", "B08").alias("_nb"), pick("after", "B04").alias("_ra"), pick("after", "B08").alias("_na"))
    diff = ndvi(c("_ra"), c("_na"), nodata) - ndvi(c("_rb"), c("_nb"), nodata)
    return (wide.select(*keys, "row_idx", "col_idx", diff.alias("ndvi_diff")).where(c("ndvi_diff").isNotNull())
            .withColumn("changed", changed(c("ndvi_diff"), threshold)))


def change_statistics(diff: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, least and greatest non-zero difference (NaN left out), changed and total pixels, percent changed."""
    v = F.when((c("ndvi_diff") != 0) & ~F.isnan("ndvi_diff"), c("ndvi_diff").cast("double"))
    hit = F.sum(c("changed").cast("bigint"))
    return diff.groupBy(*keys).agg(
        F.coalesce(F.avg(v), F.lit(0.0)).alias("mean_diff"), F.coalesce(F.min(v), F.lit(0.0)).alias("min_diff"),
        F.coalesce(F.max(v), F.lit(0.0)).alias("max_diff"), hit.alias("changed_pixels"), F.count("*").alias("total_pixels"),
        F.coalesce(F.try_divide(hit, F.count("*")) * 100, F.lit(0.0)).alias("change_percent"))


def _at(source: DataFrame, keys: list[str], row: str, col: str, tag: str) -> DataFrame:
    return source.select(*keys, c("row_idx").alias(row), c("col_idx").alias(col), c("value").cast("double").alias(tag))


def resample(source: DataFrame, target: DataFrame, keys: list[str], source_grid: Grid, target_grid: Grid,
             method: str = "nearest") -> DataFrame:
    """Source values on the target's pixels; target pixels off the source get null.

    Each target pixel computes the source pixel(s) under its centre, then joins on them.
    """
    x, y = target_grid.center_x(c("col_idx")), target_grid.center_y(c("row_idx"))
    t = target.select(*keys, "row_idx", "col_idx").withColumns({"_x": x, "_y": y})
    t = t.withColumn("_on", source_grid.holds(c("_x"), c("_y")))
    if method == "nearest":
        t = t.withColumns({"_r": F.when(c("_on"), source_grid.row_at(c("_y"))), "_c": F.when(c("_on"), source_grid.col_at(c("_x")))})
        out = t.join(_at(source, keys, "_r", "_c", "value"), [*keys, "_r", "_c"], "left")
        return out.select(*keys, "row_idx", "col_idx", "value")
    if method != "bilinear":
        raise ValueError(f"unknown method {method!r}")
    fx, fy = (c("_x") - source_grid.x0) / source_grid.dx - 0.5, (c("_y") - source_grid.y0) / source_grid.dy - 0.5
    t = t.withColumns({"_fx": fx, "_fy": fy})
    t = t.withColumns({"_c0": F.floor("_fx"), "_r0": F.floor("_fy"), "_wx": c("_fx") - F.floor("_fx"), "_wy": c("_fy") - F.floor("_fy")})
    clamp = lambda v, n: F.least(F.greatest(v, F.lit(0)), F.lit(n - 1)).cast("int")
    corner = lambda dr, dc, w: F.struct(clamp(c("_r0") + dr, source_grid.rows).alias("r"), clamp(c("_c0") + dc, source_grid.cols).alias("c"), w.alias("w"))
    wx, wy = c("_wx"), c("_wy")
    four = F.array(corner(0, 0, (1 - wx) * (1 - wy)), corner(0, 1, wx * (1 - wy)), corner(1, 0, (1 - wx) * wy), corner(1, 1, wx * wy))
    t = t.withColumn("_k", F.explode(four)).select(*keys, "row_idx", "col_idx", "_on", c("_k.r").alias("_r"), c("_k.c").alias("_c"), c("_k.w").alias("_w"))
    hit = t.join(_at(source, keys, "_r", "_c", "_v"), [*keys, "_r", "_c"], "left")
    part = F.when(c("_v").isNotNull() & c("_on"), c("_w"))
    return hit.groupBy(*keys, "row_idx", "col_idx").agg(F.try_divide(F.sum(part * c("_v")), F.sum(part)).alias("value"))


def sample(points: DataFrame, raster: DataFrame, grid: Grid, x: str, y: str, values: list[str],
           keys: list[str] | None = None) -> DataFrame:
    """Values of the nearest pixel at each point; points outside take the edge pixel."""
    keys = keys or []
    p = points.withColumns({"_r": grid.row_at(c(y)), "_c": grid.col_at(c(x))})
    r = raster.select(*keys, c("row_idx").alias("_r"), c("col_idx").alias("_c"), *values)
    return p.join(r, [*keys, "_r", "_c"], "left").drop("_r", "_c")


def terrain_at(points: DataFrame, terrain: DataFrame, grid: Grid, x: str, y: str) -> DataFrame:
    """Elevation, slope and aspect at points: no elevation stays null, missing slope or aspect is 0."""
    hit = sample(points, terrain, grid, x, y, ["elevation_m", "slope_deg", "aspect_deg"])
    known = c("elevation_m").isNotNull()
    zero = lambda k: F.when(known, F.coalesce(c(k), F.lit(0.0)))
    return hit.withColumns({"slope_deg": zero("slope_deg"), "aspect_deg": zero("aspect_deg")})


def rgb_composite(bands: DataFrame, keys: list[str]) -> DataFrame:
    """Red, green and blue bytes of B04, B03 and B02 reflectance, brightened three times."""
    wide = band_columns(bands, keys, ["B04", "B03", "B02"])
    byte = lambda b: (F.greatest(F.least(c(b) * 0.0001 * 3.0, F.lit(1.0)), F.lit(0.0)) * 255).cast("int")
    return wide.where(c("B04").isNotNull() & c("B03").isNotNull() & c("B02").isNotNull()).select(
        *keys, "row_idx", "col_idx", byte("B04").alias("r"), byte("B03").alias("g"), byte("B02").alias("b"))


def band_stack(bands: DataFrame, keys: list[str], wanted: list[str], reference: str = "B02", least: int = 4) -> DataFrame:
    """Value of every wanted band on the reference band's pixels, missing ones 0.

    Rasters without the reference band or with fewer than ``least`` wanted bands give no rows.
    """
    used = bands.where(c("band").isin(list({*wanted, reference})))
    enough = (used.groupBy(*keys).agg(F.bool_or(c("band") == reference).alias("_ref"),
                                      F.count_distinct(F.when(c("band").isin(wanted), c("band"))).alias("_n"))
              .where(c("_ref") & (c("_n") >= least)).select(*keys))
    wide = band_columns(used, keys, list(dict.fromkeys([*wanted, reference]))).where(c(reference).isNotNull())
    return wide.join(enough, keys, "left_semi").select(
        *keys, "row_idx", "col_idx", *[F.coalesce(c(b).cast("double"), F.lit(0.0)).alias(b) for b in wanted])
