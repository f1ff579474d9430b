"""Classified point clouds: terrain, surface and height grids."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landwatch.operators.skew import key_salts, salted_join

c = F.col
GROUND = 2  # fixed value: class code of ground returns


def search_tiles(tiles: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Catalog tiles that meet a box and have a data file."""
    hit = ((c("min_x") <= box[2]) & (c("max_x") >= box[0]) & (c("min_y") <= box[3]) & (c("max_y") >= box[1]))
    href = F.try_element_at(c("assets"), F.lit("data"))["href"]
    return tiles.withColumn("href", href).where(hit & c("href").isNotNull())


def within(points: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Points inside a box; plain ranges, so they reach the scan of every tile file."""
    return points.where(c("x").between(box[0], box[2]) & c("y").between(box[1], box[3]))


def _cells(points: DataFrame, resolution: float, radius: float) -> DataFrame:
    """Every (point, cell) whose centre is nearer than the radius, with the distance d."""
    k = math.ceil(radius / resolution + 0.5) - 1  # cells whose centre can be nearer than the radius
    steps = F.sequence(F.lit(-k), F.lit(k))
    p = points.withColumns({"_c": F.floor(c("x") / resolution), "_r": F.floor(c("y") / resolution)})
    p = p.withColumn("_dc", F.explode(steps)).withColumn("_dr", F.explode(steps))
    p = p.withColumns({"cell_col": (c("_c") + c("_dc")).cast("long"), "cell_row": (c("_r") + c("_dr")).cast("long")})
    d = F.hypot(c("x") - (c("cell_col") + 0.5) * resolution, c("y") - (c("cell_row") + 0.5) * resolution)
    return p.withColumn("d", d).where(c("d") < radius).drop("_c", "_r", "_dc", "_dr")


def terrain_grid(points: DataFrame, keys: list[str], resolution: float = 1.0, radius: float | None = None, power: float = 1.0) -> DataFrame:
    """Ground height per cell, weighted by inverse distance; a point on the centre gives its height.

    Sums are combined on the map side, so a dense cell costs no more than its row in the result. Of
    several points exactly on a centre the lowest counts.
    """
    near = _cells(points.where(c("classification") == GROUND), resolution, radius or resolution * math.sqrt(2))
    w = F.when(c("d") > 0, 1.0 / F.pow(c("d"), F.lit(float(power))))
    exact = F.min(F.when(c("d") == 0, c("z")))
    return near.groupBy(*keys, "cell_row", "cell_col").agg(F.coalesce(exact, F.sum(w * c("z")) / F.sum(w)).alias("dtm"))


def surface_grid(points: DataFrame, keys: list[str], resolution: float = 1.0, radius: float | None = None) -> DataFrame:
    """Greatest height of first and only returns per cell."""
    near = _cells(points.where(c("return_number") == 1), resolution, radius or resolution * math.sqrt(2))
    return near.groupBy(*keys, "cell_row", "cell_col").agg(F.max("z").alias("dsm"))


def height_grid(dtm: DataFrame, dsm: DataFrame, keys: list[str]) -> DataFrame:
    """Surface minus terrain per terrain cell, never below 0, null where the surface is unknown."""
    on = [*keys, "cell_row", "cell_col"]
    h = c("dsm") - c("dtm")
    return dtm.join(dsm, on, "left").withColumn("chm", F.when(h < 0, F.lit(0.0)).otherwise(h))


def products(points: DataFrame, keys: list[str], resolution: float = 1.0, power: float = 1.0) -> DataFrame:
    """Terrain, surface and height per cell with terrain, from one pass over the points: one aggregate with conditions."""
    ground, first = c("classification") == GROUND, c("return_number") == 1
    near = _cells(points.where(ground | first), resolution, resolution * math.sqrt(2))
    w = F.when(ground & (c("d") > 0), 1.0 / F.pow(c("d"), F.lit(float(power))))
    exact = F.min(F.when(ground & (c("d") == 0), c("z")))
    both = near.groupBy(*keys, "cell_row", "cell_col").agg(
        F.coalesce(exact, F.sum(w * c("z")) / F.sum(w)).alias("dtm"), F.max(F.when(first, c("z"))).alias("dsm"))
    h = c("dsm") - c("dtm")
    return both.where(c("dtm").isNotNull()).withColumn("chm", F.when(h < 0, F.lit(0.0)).otherwise(h))


def metadata(points: DataFrame, keys: list[str], area_m2: Column, epsg: Column, resolution: float) -> DataFrame:
    """Counts and density per product: ground points plus first returns, and points per class."""
    used = F.count_if(c("classification") == GROUND) + F.count_if(c("return_number") == 1)
    total = points.groupBy(*keys).agg(used.alias("point_count"), F.first(area_m2).alias("_area"), F.first(epsg).alias("crs_epsg"))
    per_class = points.groupBy(*keys, "classification").agg(F.count("*").alias("_n"))
    classes = per_class.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("classification", "_n")))).alias("classification_counts"))
    both = total.join(classes, keys) if keys else total.crossJoin(classes)
    density = F.when(c("_area") > 0, F.round(c("point_count") / c("_area"), 2)).otherwise(F.lit(0.0))
    return both.withColumns({"point_density_per_m2": density, "resolution_m": F.lit(resolution)}).drop("_area")


def polygon_points(boxes: DataFrame, points: DataFrame, key: str, cell: float) -> DataFrame:
    """(box, point) for every point inside each box (min_x, min_y, max_x, max_y), joined on grid cells.

    Boxes without points give no rows, as failed products are skipped.
    """
    b = boxes.select(key, "min_x", "min_y", "max_x", "max_y")
    b = (b.withColumn("_gx", F.explode(F.sequence(F.floor(c("min_x") / cell), F.floor(c("max_x") / cell))))
         .withColumn("_gy", F.explode(F.sequence(F.floor(c("min_y") / cell), F.floor(c("max_y") / cell)))))
    p = points.withColumns({"_gx": F.floor(c("x") / cell), "_gy": F.floor(c("y") / cell)})
    inside = c("x").between(c("min_x"), c("max_x")) & c("y").between(c("min_y"), c("max_y"))
    return salted_join(b, p.withColumn("_pid", F.xxhash64(*points.columns)), ["_gx", "_gy"], key, "_pid").drop("_pid").where(inside).drop("_gx", "_gy", "min_x", "min_y", "max_x", "max_y")


SUMS = ("sum_w", "sum_wz", "n_wz", "exact", "dsm")


def cut_sums(x: np.ndarray, y: np.ndarray, z: np.ndarray, ground: np.ndarray, first: np.ndarray, cuts: np.ndarray,
             resolution: float, radius: float, power: float, most: int = 1 << 21) -> tuple[np.ndarray, ...]:
    """What the points of one square give to the cells around it, for every cut (least x, y, greatest x, y) of the square.

    Returns the cells' (row, column) and arrays (cut, cell) of the sums of weights, of weighted heights and their number, the least
    height on a centre and the greatest of first returns. An absent height is masked in ``z``; a matrix of cuts and points
    has at most about ``most`` entries.
    """
    known, z = ~np.ma.getmaskarray(z), np.ma.getdata(z)
    k = math.ceil(radius / resolution + 0.5) - 1
    base_c, base_r = math.floor(x[0] / resolution), math.floor(y[0] / resolution)
    cells = [(base_r + dr, base_c + dc) for dr in range(-k, k + 1) for dc in range(-k, k + 1)]
    d = np.stack([np.hypot(x - (col + 0.5) * resolution, y - (row + 0.5) * resolution) for row, col in cells], 1)
    near = d < radius
    with np.errstate(divide="ignore", invalid="ignore"):
        w = np.where(ground[:, None] & near & (d > 0), 1.0 / np.power(d, power), 0.0)
    used = (w > 0) & known[:, None]
    wild = np.flatnonzero(known & ~np.isfinite(z))  # their products would spread over all cuts
    wz = np.where(used & np.isfinite(z)[:, None], w * np.where(np.isfinite(z), z, 0.0)[:, None], 0.0)
    table = np.concatenate([w, wz, used.astype(float)], 1)
    on = [np.flatnonzero(ground & known & (d[:, i] == 0) & near[:, i]) for i in range(len(cells))]
    top = np.flatnonzero(first & known & near.any(1))
    top = top[np.lexsort((-np.nan_to_num(z[top], nan=0.0), ~np.isnan(z[top])))]  # NaN is the greatest
    out = [np.zeros((len(cuts), len(cells))) for _ in range(3)] + [np.full((len(cuts), len(cells)), np.inf), np.full((len(cuts), len(cells)), -np.inf)]
    has = [np.zeros((len(cuts), len(cells)), bool) for _ in range(2)]
    step = max(1, most // max(1, len(x)))
    for lo in range(0, len(cuts), step):
        part = slice(lo, lo + step)
        x0, y0, x1, y1 = (v[:, None] for v in cuts[part].T)
        held = (x >= x0) & (x <= x1) & (y >= y0) & (y <= y1)
        sums = held.astype(float) @ table
        for to, values in zip(out, np.split(sums, 3, axis=1)):
            to[part] = values
        for p in wild:
            out[1][part] += np.where(held[:, p, None] & used[p], np.where(used[p], w[p], 1.0) * z[p], 0.0)
        for i, points in enumerate(on):
            if len(points):
                inside = held[:, points]
                has[0][part, i] = inside.any(1)
                out[3][part, i] = np.fmin.reduce(np.where(inside, z[points], np.inf), axis=1)
        best, found, at, width = out[4][part], has[1][part], 0, 64
        left = np.arange(len(held))
        while at < len(top) and len(left):  # from the highest point down, until every cell has met one
            points = top[at:at + width]
            inside = held[np.ix_(left, points)]
            for i in range(len(cells)):
                hit = inside & near[points, i]
                new = hit.any(1) & ~found[left, i]
                best[left[new], i] = z[points[hit[new].argmax(1)]]
                found[left[new], i] = True
            at, width = at + width, min(4096, width * 4)
            left = left[~found[left].all(1)]
    return cells, *out[:3], np.ma.array(out[3], mask=~has[0]), np.ma.array(out[4], mask=~has[1])


def _square_sums(points: DataFrame, cuts: DataFrame, resolution: float, radius: float, power: float, rows: int) -> DataFrame:
    """Sums of ``cut_sums`` for every square (_gx, _gy) of points and every cut of it: a task holds ``rows`` points of a square."""
    square, bounds = ["_gx", "_gy"], ["_x0", "_y0", "_x1", "_y1"]
    schema = T.StructType([*[T.StructField(k, T.LongType()) for k in square], *[T.StructField(k, T.DoubleType()) for k in bounds],
                           *[T.StructField(k, T.LongType()) for k in ("cell_row", "cell_col")], *[T.StructField(k, T.DoubleType()) for k in SUMS]])

    def combine(p: pa.Table, q: pa.Table) -> pa.Table:
        if not p.num_rows or not q.num_rows:
            return schema_table.slice(0, 0)
        get = lambda t, k: t[k].combine_chunks().to_numpy(zero_copy_only=False)
        z = np.ma.array(get(p.set_column(p.column_names.index("z"), "z", p["z"].fill_null(0.0)), "z"), mask=get(p.append_column("_no", p["z"].is_null()), "_no"))
        cut = np.stack([get(q, k) for k in bounds], 1)
        cells, *sums = cut_sums(get(p, "x"), get(p, "y"), z, get(p, "_ground"), get(p, "_first"), cut, resolution, radius, power)
        any_ = (sums[0] > 0) | ~np.ma.getmaskarray(sums[3]) | ~np.ma.getmaskarray(sums[4])
        i, j = np.nonzero(any_)
        where = np.array(cells, np.int64)[j]
        columns = [*[pa.array(np.full(len(i), q[k][0].as_py(), np.int64)) for k in square], *[pa.array(cut[i, n]) for n in range(4)],
                   pa.array(where[:, 0]), pa.array(where[:, 1]),
                   *[pa.array(np.ma.getdata(v)[i, j], mask=np.ma.getmaskarray(v)[i, j]) for v in sums]]
        return pa.table(dict(zip(schema.names, columns)))

    schema_table = pa.table({f.name: pa.array([], pa.int64() if isinstance(f.dataType, T.LongType) else pa.float64()) for f in schema})
    salts = key_salts(points, square, rows)
    n = F.coalesce("_n", F.lit(1))
    p = points.join(salts, square, "left").withColumn("_salt", F.pmod(F.xxhash64(*points.columns), n).cast("int")).drop("_n")
    q = cuts.join(salts, square, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), n - 1))).drop("_n")
    by = [*square, "_salt"]
    return p.groupBy(*by).cogroup(q.groupBy(*by)).applyInArrow(combine, schema)


def polygon_products(boxes: DataFrame, points: DataFrame, key: str, pad: float, resolution: float = 1.0, rows: int = 50_000) -> DataFrame:
    """Terrain, surface and height cells of every box widened by ``pad``, with the box id in the key.

    No (box, point) pair is listed. A box is cut into squares of the grid; what a square's points give to the cells around
    is summed once for each way in which boxes cut it (a square wholly inside has one), and a box adds up its squares' sums.
    Squares with over ``rows`` points are summed in parts.
    """
    edge = lambda k, sign: c(k) + sign * pad
    b = boxes.select(key, edge("min_x", -1).alias("_x0"), edge("min_y", -1).alias("_y0"), edge("max_x", 1).alias("_x1"), edge("max_y", 1).alias("_y1"))
    b = b.where((c("_x0") <= c("_x1")) & (c("_y0") <= c("_y1")))
    at = lambda k: F.floor(c(k) / resolution)
    b = b.withColumn("_gx", F.explode(F.sequence(at("_x0"), at("_x1")))).withColumn("_gy", F.explode(F.sequence(at("_y0"), at("_y1"))))
    inf = float("inf")
    b = b.withColumns({"_x0": F.when(c("_gx") == at("_x0"), c("_x0")).otherwise(-inf), "_x1": F.when(c("_gx") == at("_x1"), c("_x1")).otherwise(inf),
                       "_y0": F.when(c("_gy") == at("_y0"), c("_y0")).otherwise(-inf), "_y1": F.when(c("_gy") == at("_y1"), c("_y1")).otherwise(inf)})
    cut = ["_gx", "_gy", "_x0", "_y0", "_x1", "_y1"]
    ground, first = (F.coalesce(t, F.lit(False)) for t in (c("classification") == GROUND, c("return_number") == 1))
    p = points.where(c("x").isNotNull() & c("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y") & (ground | first)).select(
        F.floor(c("x") / resolution).alias("_gx"), F.floor(c("y") / resolution).alias("_gy"), "x", "y", "z", ground.alias("_ground"), first.alias("_first"))
    sums = _square_sums(p, b.select(*cut).distinct(), resolution, resolution * math.sqrt(2), 1.0, rows)
    total = b.join(sums, cut).groupBy(key, "cell_row", "cell_col").agg(
        *[F.sum(k).alias(k) for k in SUMS[:3]], F.min("exact").alias("exact"), F.max("dsm").alias("dsm"))
    dtm = F.coalesce("exact", F.when(c("n_wz") > 0, c("sum_wz") / c("sum_w")))
    h = c("dsm") - c("dtm")
    return (total.withColumn("dtm", dtm).where(c("dtm").isNotNull()).withColumn("chm", F.when(h < 0, F.lit(0.0)).otherwise(h))
            .select(key, "cell_row", "cell_col", "dtm", "dsm", "chm"))


def surface_sample(raster: DataFrame, keys: list[str], value: str, most: int, nodata: float = -9999.0) -> DataFrame:
    """Every n-th cell, so that no axis keeps more than about ``most``, with height scaled to 0..1."""
    v = F.when((c(value) != nodata) & (F.abs(c(value)) != float("inf")), c(value))
    size = raster.groupBy(*keys).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"), (F.max("row_idx") + 1).alias("_h"), (F.max("col_idx") + 1).alias("_w"))
    step = lambda n: F.greatest(F.lit(1), F.floor(c(n) / most)).cast("int")
    joined = (raster.join(size, keys) if keys else raster.crossJoin(F.broadcast(size))).withColumns({"_sy": step("_h"), "_sx": step("_w")})
    kept = joined.where((c("row_idx") % c("_sy") == 0) & (c("col_idx") % c("_sx") == 0)
                        & (c("row_idx") / c("_sy") < F.floor(c("_h") / c("_sy"))) & (c("col_idx") / c("_sx") < F.floor(c("_w") / c("_sx"))))
    span = F.when(c("_hi") == c("_lo"), F.lit(1.0)).otherwise(c("_hi") - c("_lo"))
    return kept.select(*keys, (c("row_idx") / c("_sy")).cast("int").alias("row"), (c("col_idx") / c("_sx")).cast("int").alias("col"),
                       F.coalesce((v - c("_lo")) / span, F.lit(0.0)).alias("height"))
