"""Bulk loads that split their input into accepted and rejected rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landwatch.functions import geometry as G

c = F.col


def _split(df: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    marked = df.withColumn("error", error)
    return marked.where(c("error").isNull()).drop("error"), marked.where(c("error").isNotNull())


def load_events(batch: DataFrame, changes: DataFrame, assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events whose change and asset exist, and the others with the first reason that applies."""
    known_changes = changes.select("change_id").distinct().withColumn("_c", F.lit(True))
    known_assets = assets.select("asset_id").distinct().withColumn("_a", F.lit(True))
    df = batch.join(known_changes, "change_id", "left").join(known_assets, "asset_id", "left")
    error = (F.when(c("change_id").isNull(), "Missing change polygon ID").when(c("_c").isNull(), "Change polygon not found")
             .when(c("_a").isNull(), "Asset not found"))
    good, bad = _split(df, error)
    return good.drop("_c", "_a"), bad.drop("_c", "_a")


def load_changes(batch: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Polygon changes of known runs; a multi-polygon gives its largest member."""
    known = runs.select("run_id").distinct().withColumn("_r", F.lit(True))
    df = batch.join(known, "run_id", "left")
    kind = c("geometry.type")
    error = (F.when(c("_r").isNull(), "Processing run not found").when(c("geometry").isNull(), "Geometry is null in request")
             .when(~kind.isin("Polygon", "MultiPolygon"),
                   F.concat(F.lit("Geometry must be a Polygon or MultiPolygon, got "), kind)))
    good, bad = _split(df, error)
    return good.withColumn("geometry", G.largest_part(c("geometry"))).drop("_r"), bad.drop("_r")


def make_asset_id(aoi_id: Column, *content: Column) -> Column:
    """Area id, a dash and the whole digest of the content: the same on every retry, and no area's id shortens it."""
    return F.concat(aoi_id, F.lit("-"), F.sha2(F.concat_ws("|", *content), 256))


def load_assets(batch: DataFrame, existing: DataFrame, areas: DataFrame, order: str,
                request_source: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """New assets of known areas with a usable geometry; ids already stored or seen earlier are refused.

    Of equal ids in one batch the first by ``order`` is taken, found by an aggregate instead of a
    sort of the group. A row with a bad geometry does not claim its id.
    """
    df = batch.withColumn("source_dataset", F.coalesce("source_dataset", request_source)) if request_source is not None else batch
    known = areas.select("aoi_id").distinct().withColumn("_area", F.lit(True))
    stored = existing.select("aoi_id", "asset_id").distinct().withColumn("_old", F.lit(True))
    df = df.join(known, "aoi_id", "left").join(stored, ["aoi_id", "asset_id"], "left")
    box = G.bounds(c("geometry"))
    sound = F.coalesce(G.in_degrees(*box), F.lit(False))
    df = df.withColumn("_sound", sound)
    claims = (df.where(c("_sound") & c("_old").isNull() & c("_area").isNotNull())
              .groupBy("aoi_id", "asset_id").agg(F.min(order).alias("_first")))
    df = df.join(claims, ["aoi_id", "asset_id"], "left")
    error = (F.when(c("_area").isNull(), "Area of Interest not found")
             .when(c("_old").isNotNull() | (c("_first") < c(order)), "Asset already exists")
             .when(~c("_sound"), "Invalid geometry"))
    good, bad = _split(df, error)
    extra = ["_area", "_old", "_first", "_sound"]
    return good.drop(*extra), bad.drop(*extra)


def load_areas(batch: DataFrame, existing: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """New areas with a four-number box and an unused id."""
    stored = existing.select("aoi_id").distinct().withColumn("_old", F.lit(True))
    df = batch.join(stored, "aoi_id", "left")
    claims = df.where(c("_old").isNull()).groupBy("aoi_id").agg(F.min(order).alias("_first"))
    df = df.join(claims, "aoi_id", "left")
    error = (F.when(c("_old").isNotNull() | (c("_first") < c(order)), "Area of Interest already exists")
             .when(F.coalesce(F.size("bounding_box") != 4, F.lit(True)), "BoundingBox must have 4 values"))
    good, bad = _split(df, error)
    return good.drop("_old", "_first"), bad.drop("_old", "_first")


def load_runs(batch: DataFrame, areas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs of known areas, waiting; dates are taken as UTC."""
    known = areas.select("aoi_id").distinct().withColumn("_area", F.lit(True))
    good, bad = _split(batch.join(known, "aoi_id", "left"), F.when(c("_area").isNull(), "Area of Interest not found"))
    return good.drop("_area").withColumn("status", F.lit(0)), bad.drop("_area")


def outcome(good: DataFrame, bad: DataFrame) -> DataFrame:
    """Success and failure counts with the true number per reason."""
    ok = good.agg(F.count("*").alias("rows")).select(F.lit(None).cast("string").alias("error"), "rows")
    return ok.unionByName(bad.groupBy("error").agg(F.count("*").alias("rows")))


def error_sample(bad: DataFrame, key: str, size: int) -> DataFrame:
    """The first failures by key, for display."""
    return bad.orderBy(key).limit(size)


