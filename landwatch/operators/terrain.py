"""Slope and aspect of elevation rasters, and statistics of polygons over them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landwatch.functions import geometry as G
from landwatch.functions import kernels as K
from landwatch.operators.raster import Grid
from landwatch.operators.skew import salted_join

c = F.col


def horn(padded: np.ndarray, cell: float, east_west: str = "stored") -> tuple[np.ndarray, np.ndarray]:
    """Slope and aspect in degrees of the inner cells of an array with a border of one.

    With ``east_west="stored"`` the east-west direction is the mirrored one that stored results use;
    ``"true"`` gives the compass direction of descent.
    """
    z = padded
    west = z[:-2, :-2] + 2 * z[1:-1, :-2] + z[2:, :-2]
    east = z[:-2, 2:] + 2 * z[1:-1, 2:] + z[2:, 2:]
    north = z[:-2, :-2] + 2 * z[:-2, 1:-1] + z[:-2, 2:]
    south = z[2:, :-2] + 2 * z[2:, 1:-1] + z[2:, 2:]
    dx, dy = (west - east) / (8 * cell), (south - north) / (8 * cell)
    aspect = np.degrees(np.arctan2(-dx if east_west == "stored" else dx, dy))
    return np.degrees(np.arctan(np.sqrt(dx * dx + dy * dy))), np.where(aspect < 0, aspect + 360, aspect)


def slope_aspect(dem: DataFrame, keys: list[str], cell_m: float, tile: int = 256, east_west: str = "stored") -> DataFrame:
    """Add slope_deg and aspect_deg to elevation pixels (keys, row_idx, col_idx, elevation_m).

    Pixels on a tile border are also sent to the neighbouring tile, so one shuffle of the raster (plus
    its border pixels) serves all nine neighbours and a task holds one tile. Missing elevation counts
    as 0 for its neighbours and gives null; beyond the raster the edge repeats.
    """
    extent = dem.groupBy(*keys).agg(F.min("row_idx").alias("r0"), F.max("row_idx").alias("r1"),
                                    F.min("col_idx").alias("c0"), F.max("col_idx").alias("c1"))
    reach = lambda k: F.explode(F.array_distinct(F.array(*[F.floor((c(k) + d) / tile) for d in (-1, 0, 1)])))
    spread = (dem.select(*keys, "row_idx", "col_idx", "elevation_m").withColumn("tile_row", reach("row_idx"))
              .withColumn("tile_col", reach("col_idx")))
    spread = spread.join(extent, keys) if keys else spread.crossJoin(F.broadcast(extent))
    schema = T.StructType([*[dem.schema[k] for k in keys], T.StructField("row_idx", T.IntegerType()),
                           T.StructField("col_idx", T.IntegerType()), T.StructField("elevation_m", T.DoubleType()),
                           T.StructField("slope_deg", T.FloatType()), T.StructField("aspect_deg", T.FloatType())])

    def derive(table: pa.Table) -> pa.Table:
        get = lambda k: table[k].to_numpy()
        row, col = get("row_idx").astype(np.int64), get("col_idx").astype(np.int64)
        z = table["elevation_m"].cast(pa.float64()).fill_null(np.nan).to_numpy()
        top, left = int(get("tile_row")[0]) * tile, int(get("tile_col")[0]) * tile
        block = np.zeros((tile + 2, tile + 2))
        block[row - top + 1, col - left + 1] = np.nan_to_num(z)
        lines = np.clip(np.arange(top - 1, top + tile + 1), get("r0")[0], get("r1")[0]) - (top - 1)
        files = np.clip(np.arange(left - 1, left + tile + 1), get("c0")[0], get("c1")[0]) - (left - 1)
        keep_l, keep_f = np.clip(lines, 0, tile + 1), np.clip(files, 0, tile + 1)
        slope, aspect = horn(block[keep_l][:, keep_f], cell_m, east_west)
        own = np.flatnonzero((row >= top) & (row < top + tile) & (col >= left) & (col < left + tile))
        known = ~np.isnan(z[own])
        pick = lambda a: pa.array(a[row[own] - top, col[own] - left].astype(np.float32), mask=~known)
        out = table.select(keys).take(pa.array(own))
        for name, arr in (("row_idx", pa.array(row[own].astype(np.int32))), ("col_idx", pa.array(col[own].astype(np.int32))),
                          ("elevation_m", pa.array(z[own], mask=~known)), ("slope_deg", pick(slope)), ("aspect_deg", pick(aspect))):
            out = out.append_column(name, arr) if out.num_columns else pa.table({name: arr})
        return out

    return spread.groupBy(*keys, "tile_row", "tile_col").applyInArrow(derive, schema)


def zone_spans(zones: DataFrame, grid: Grid, zone_key: str, keys: list[str] | None = None) -> DataFrame:
    """Zones as spans of pixels: keys, zone_key, row_idx, c0, c1 for pixels whose centre lies inside the polygon.

    A polygon is read once, where it is stored, and given away as plain numbers in bounded batches, however
    many vertices or rows it has. Null and empty geometries give no spans.
    """
    names = [*(keys or []), zone_key]
    z = zones.where(c("geometry").isNotNull()).select(*names, c("geometry.parts").alias("_parts"))
    z = z.repartition(z.sparkSession.sparkContext.defaultParallelism, *names)  # few bytes, but many spans a zone
    schema = T.StructType([*[zones.schema[k] for k in names], *[T.StructField(k, T.IntegerType()) for k in ("row_idx", "c0", "c1")]])

    def scan(batches):
        for batch in batches:
            g = K.Ragged(batch.column("_parts"))
            for shape, *span in K.row_spans(g, grid.x0, grid.y0, grid.dx, grid.dy, grid.rows, grid.cols):
                held = batch.select(names).take(pa.array(shape))
                yield pa.RecordBatch.from_arrays([*held.columns, *[pa.array(v, pa.int32()) for v in span]], names=[*names, "row_idx", "c0", "c1"])

    return z.mapInArrow(scan, schema)


def zonal_pixels(zones: DataFrame, pixels: DataFrame, grid: Grid, zone_key: str, values: list[str],
                 keys: list[str] | None = None, tile: int = 32) -> DataFrame:
    """(zone, pixel values) for every pixel whose centre lies inside the zone polygon.

    Zones become row spans, cut into pieces of ``tile`` columns, which meet the pixels of their row and
    piece; a piece bounds its pixels, and pieces under very many zones are salted by zone. No polygon goes
    through the join.
    """
    keys = keys or []
    spans = zone_spans(zones, grid, zone_key, keys).withColumn(
        "_piece", F.explode(F.sequence(F.floor(c("c0") / tile), F.floor(c("c1") / tile))))
    p = pixels.select(*keys, "row_idx", "col_idx", *values).withColumn("_piece", F.floor(c("col_idx") / tile))
    met = salted_join(spans, p, [*keys, "row_idx", "_piece"], left_id=zone_key).where(c("col_idx").between(c("c0"), c("c1")))
    return met.select(*keys, zone_key, "row_idx", "col_idx", *values)


def circular_mean(angle: str):
    """Mean direction in degrees of an angle column."""
    turn = F.degrees(F.atan2(F.avg(F.sin(F.radians(angle))), F.avg(F.cos(F.radians(angle)))))
    return F.pmod(turn, F.lit(360.0))


def terrain_statistics(zones: DataFrame, terrain: DataFrame, grid: Grid, zone_key: str,
                       keys: list[str] | None = None, tile: int = 32) -> DataFrame:
    """Zones with mean elevation, mean and greatest slope and mean aspect; 0 where no pixel lies inside."""
    keys = keys or []
    hits = zonal_pixels(zones, terrain, grid, zone_key, ["elevation_m", "slope_deg", "aspect_deg"], keys, tile)
    stats = hits.groupBy(*keys, zone_key).agg(
        F.avg("elevation_m").alias("elevation_m"), F.avg(c("slope_deg").cast("double")).alias("slope_degree_mean"),
        F.max(c("slope_deg").cast("double")).alias("slope_degree_max"), circular_mean("aspect_deg").alias("aspect_degrees"))
    names = ["elevation_m", "slope_degree_mean", "slope_degree_max", "aspect_degrees"]
    plain = zones.drop(*names)
    return plain.join(stats, [*keys, zone_key], "left").na.fill(0.0, names)


DEM_SOURCES = ("3dep", "lidar", "local")  # fixed values


def choose_dem(dem: DataFrame, source: str, keys: list[str] | None = None, pixel: tuple[str, ...] = ("row_idx", "col_idx")) -> DataFrame:
    """Elevation rows of the wanted source; lidar falls back to 3dep pixel rasters where it has none.

    ``dem`` has source, tile_id and pixel columns. All tiles of the source form one mosaic; where
    tiles overlap the first by id gives the pixel. Unknown sources give no rows.
    """
    keys = keys or []
    order = {"3dep": ["3dep"], "lidar": ["lidar", "3dep"], "local": ["local"]}.get(source, [])
    if not order:
        return dem.limit(0)
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), c("source"))
    usable = dem.where(c("source").isin(order)).withColumn("_rank", rank)
    best = usable.groupBy(*keys).agg(F.min("_rank").alias("_best"))
    joined = usable.join(best, keys) if keys else usable.crossJoin(F.broadcast(best))
    chosen = joined.where(c("_rank") == c("_best")).drop("_rank", "_best")
    rest = [k for k in dem.columns if k not in (*keys, *pixel)]
    first = F.min_by(F.struct(*rest), "tile_id").alias("_first")
    return chosen.groupBy(*keys, *pixel).agg(first).select(*keys, *pixel, "_first.*").select(*dem.columns)
