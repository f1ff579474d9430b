"""From band tables to scored risk events, for all areas and runs in one plan."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landwatch.config import ProcessingConfig
from landwatch.functions import geometry as G
from landwatch.functions import kernels as K
from landwatch.functions.change import change_type
from landwatch.operators import proximity, raster, regions, scoring, terrain
from landwatch.session import cut_lineage

c = F.col


def to_map(shapes: DataFrame, rasters: DataFrame, keys: list[str]) -> DataFrame:
    """Polygons from pixel corners to degrees, by the origin, pixel size and UTM zone of their raster.

    ``rasters`` has keys, x0, y0, dx, dy, zone and south.
    """
    d = shapes.join(rasters, keys)
    plane = F.transform("geometry.parts", lambda p: F.transform(p, lambda r: F.transform(
        r, lambda v: G.vertex(c("x0") + v["x"] * c("dx"), c("y0") + v["y"] * c("dy")))))
    d = d.withColumn("_plane", plane)
    d = d.withColumn("geometry", G.geometry(c("geometry.type"), K.unproject_parts("_plane", "zone", "south")))
    return d.drop("_plane", "x0", "y0", "dx", "dy", "zone", "south", "rows", "cols")


def pixel_of(x: Column, y: Column) -> dict[str, Column]:
    """Clamped pixel under a position in the raster's plane; reads the raster's columns."""
    edge = lambda v, n: F.least(F.greatest(F.floor(v), F.lit(0)), c(n) - 1).cast("int")
    return {"col_idx": edge((x - c("x0")) / c("dx"), "cols"), "row_idx": edge((y - c("y0")) / c("dy"), "rows")}


def asset_elevation(assets: DataFrame, dem: DataFrame, rasters: DataFrame, keys: list[str], matched: DataFrame | None = None) -> DataFrame:
    """Elevation of the nearest pixel at each asset's centroid: keys, asset_id, asset_elevation_m.

    For the (keys, asset_id) rows of ``matched``, or for every raster of each asset's area.
    """
    at = assets.where(c("geometry").isNotNull()).withColumn("_at", G.centroid(c("geometry")))
    on = [k for k in keys if k in assets.columns]
    if not on:
        raise ValueError("assets need a raster key such as aoi_id")
    if matched is None:
        at = at.join(rasters, on)
    else:
        at = matched.join(at, [*on, "asset_id"]).join(rasters, keys)
    spot = F.array(F.array(F.array(c("_at"))))
    at = at.withColumn("_plane", F.flatten(F.flatten(K.project_parts(spot, "zone", "south")))[0])
    at = at.withColumns(pixel_of(c("_plane.x"), c("_plane.y")))
    return (at.select(*keys, "asset_id", "row_idx", "col_idx")
            .join(dem.select(*keys, "row_idx", "col_idx", c("elevation_m").alias("asset_elevation_m")), [*keys, "row_idx", "col_idx"], "left")
            .select(*keys, "asset_id", "asset_elevation_m"))


def detect(bands: DataFrame, dem: DataFrame | None, rasters: DataFrame, keys: list[str], cell_m: float,
           config: ProcessingConfig = ProcessingConfig()) -> dict[str, DataFrame]:
    """Difference raster, its statistics, and changes with polygons, area, drop and terrain.

    ``bands`` has keys, side ("before" or "after"), band, row_idx, col_idx and value. Both index rasters
    and their difference come from one shuffle; labels carry the difference, so region statistics are
    a plain aggregate.
    """
    diff = raster.paired_difference(bands, keys, config.ndvi_threshold)
    labelled = cut_lineage(regions.label_regions(diff.where("changed = 1"), keys, config.tile_size, carry=("ndvi_diff",)))
    stats = regions.region_statistics(labelled, keys).withColumn("area_sq_meters", c("pixels") * F.lit(cell_m * cell_m))
    stats = cut_lineage(stats.where(c("area_sq_meters") >= config.min_area_m2).drop("pixels"))
    kept = labelled.join(stats.select(*keys, "component_id"), [*keys, "component_id"], "left_semi")
    # The centroid of a region is the mean of its pixel centres.
    centre = kept.groupBy(*keys, "component_id").agg((F.avg("col_idx") + 0.5).alias("c_col"), (F.avg("row_idx") + 0.5).alias("c_row"))
    shapes = to_map(regions.region_polygons(kept, keys, None, config.tile_size), rasters, keys)
    ident = F.concat_ws("|", *keys, "component_id")
    changes = (shapes.join(stats, [*keys, "component_id"]).join(centre, [*keys, "component_id"])
               .withColumns({"change_id": F.left(F.sha2(ident, 256), F.lit(32)), "change_type": change_type(c("ndvi_drop_mean"))}))
    if dem is not None:
        t = terrain.slope_aspect(dem, keys, cell_m, config.tile_size)
        zone = kept.join(t, [*keys, "row_idx", "col_idx"], "left").groupBy(*keys, "component_id").agg(
            F.avg("elevation_m").alias("elevation_m"), F.avg(c("slope_deg").cast("double")).alias("slope_degree_mean"),
            F.max(c("slope_deg").cast("double")).alias("slope_degree_max"), terrain.circular_mean("aspect_deg").alias("aspect_degrees"))
        zone = zone.na.fill(0.0, ["elevation_m", "slope_degree_mean", "slope_degree_max", "aspect_degrees"])
        changes = changes.join(zone, [*keys, "component_id"], "left")
    else:
        changes = changes.withColumns({k: F.lit(None).cast("double") for k in ("elevation_m", "slope_degree_mean", "slope_degree_max", "aspect_degrees")})
    changes = changes.withColumns({"land_cover_class": F.lit(None).cast("string"), "ml_confidence": F.lit(None).cast("double"),
                                   "ml_model_version": F.lit(None).cast("string")})
    return {"diff": diff, "stats": raster.change_statistics(diff, keys), "changes": changes}


def score(changes: DataFrame, assets: DataFrame, dem: DataFrame | None, rasters: DataFrame, keys: list[str],
          max_distance_m: float, overrides: dict[str, Any] | None = None) -> DataFrame:
    """Risk events of changes and the assets of their area within the search distance."""
    if dem is not None:  # one row a change, so the pairs need not be shuffled for it
        heights = dem.select(*keys, c("row_idx").alias("_r"), c("col_idx").alias("_c"), c("elevation_m").alias("change_elevation_m"))
        at = changes.withColumns({"_r": F.floor("c_row").cast("int"), "_c": F.floor("c_col").cast("int")})
        changes = at.join(heights, [*keys, "_r", "_c"], "left").drop("_r", "_c")
    area = [k for k in keys if k in assets.columns]
    names = [k for k in assets.columns if k not in area]
    clash = {k: f"asset_{k}" for k in names if k in changes.columns and k not in ("geometry", "asset_id")}
    pairs = proximity.distance_join(changes, assets.withColumnsRenamed(clash), max_distance_m, within=area or None).drop("change_geometry", "asset_geometry", "centroid")
    pairs = cut_lineage(pairs.drop("pixels"))  # read twice below: the join runs once
    if dem is None:
        pairs = pairs.withColumns({"elevation_diff_m": F.lit(None).cast("double"), "is_upslope": F.lit(None).cast("boolean")})
    else:
        pairs = pairs.join(asset_elevation(assets, dem, rasters, keys, pairs.select(*keys, "asset_id").distinct()), [*keys, "asset_id"], "left")
        pairs = proximity.directional(pairs)
    scored = scoring.score_pairs(scoring.with_criticality_name(pairs), overrides)
    return scored.withColumn("risk_event_id", F.left(F.sha2(F.concat_ws("|", "change_id", "asset_id"), 256), F.lit(32)))


def change_to_risk(bands: DataFrame, rasters: DataFrame, assets: DataFrame, dem: DataFrame | None = None, keys: list[str] = ["aoi_id", "run_id"],
                   cell_m: float = 10.0, config: ProcessingConfig = ProcessingConfig(), overrides: dict[str, Any] | None = None,
                   land_cover: Callable[[DataFrame], DataFrame] | None = None,
                   landslides: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """Changes, risk events, statistics and a summary per run.

    ``land_cover`` maps changes to (change_id, land_cover_class), ``landslides`` maps steep changes to
    (change_id, is_landslide, landslide_probability); either may be left out, and its columns stay null.
    """
    found = detect(bands, dem, rasters, keys, cell_m, config)
    changes = found["changes"]
    if land_cover is not None or landslides is not None:
        changes = cut_lineage(changes)  # patches are cut around them and the verdicts are joined to them
    if land_cover is not None:
        cover = land_cover(changes).groupBy("change_id").agg(F.min("land_cover_class").alias("land_cover_class"))  # one row a change
        changes = changes.drop("land_cover_class").join(cover, "change_id", "left")
        refined = F.when(c("land_cover_class").isNotNull(), change_type(c("ndvi_drop_mean"), c("land_cover_class")))
        changes = changes.withColumn("change_type", F.coalesce(refined, "change_type"))
    if landslides is not None:
        from landwatch.operators.patches import refine_types
        steep = changes.where(c("slope_degree_mean") >= config.landslide_min_slope_deg)
        changes = refine_types(changes, landslides(steep), "change_id", "landslide-model")
    changes = cut_lineage(changes)
    events = score(changes, assets, dem, rasters, keys, config.max_distance_m, overrides)
    tally = changes.groupBy(*keys).agg(
        F.count_distinct("change_id").alias("polygon_count"), F.bool_or(c("land_cover_class").isNotNull()).alias("has_land_cover"),
        F.min("ml_model_version").alias("ml_model_version"))
    hits = events.groupBy(*keys).agg(F.count("*").alias("risk_event_count"))
    summary = tally.join(hits, keys, "left").na.fill(0, ["risk_event_count"])
    return {"diff": found["diff"], "stats": found["stats"], "changes": changes, "risk_events": events, "summary": summary}
