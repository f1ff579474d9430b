"""Scene catalog: reading items, searching and choosing scenes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landwatch.operators.ranking import first_by
from landwatch.schema import SCENE_BANDS
from landwatch.sources.split_json import array_elements

c = F.col
ITEM = ("struct<id:string,bbox:array<double>,properties:struct<datetime:string,`eo:cloud_cover`:double,platform:string,"
        "`proj:epsg`:int,gsd:double,instruments:array<string>>,assets:map<string,struct<href:string,type:string>>>")


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Scene rows of item-collection JSON files; one large file is read by many tasks."""
    return parse_items(array_elements(spark, path, "features"), "text")


def parse_items(df: DataFrame, text: str) -> DataFrame:
    """Scene rows of one item JSON text per row."""
    return item_rows(df.withColumn("item", F.from_json(text, ITEM)), c("item"))


def item_rows(df: DataFrame, item: Column, now: Column | None = None) -> DataFrame:
    """Normalised scenes: known bands only, cloud 0 when absent, defaults for date and box."""
    p = item["properties"]
    at = F.to_timestamp(p["datetime"])
    bands = F.map_filter(F.coalesce(item["assets"], F.from_json(F.lit("{}"), "map<string,struct<href:string,type:string>>")),
                         lambda k, v: k.isin(SCENE_BANDS))
    box = item["bbox"]
    corner = lambda i: F.coalesce(F.get(box, F.lit(i)), F.lit(0.0))
    return df.select(
        item["id"].alias("scene_id"), F.coalesce(at, now if now is not None else F.current_timestamp()).alias("acquired_at"),
        F.coalesce(p["eo:cloud_cover"], F.lit(0.0)).alias("cloud_cover"),
        corner(0).alias("min_lon"), corner(1).alias("min_lat"), corner(2).alias("max_lon"), corner(3).alias("max_lat"),
        bands.alias("bands"), p["platform"].alias("platform"), p["proj:epsg"].alias("epsg"))


def band_url(bands: Column, band: str) -> Column:
    """Address of a band, null when the scene lacks it."""
    return F.try_element_at(bands, F.lit(band))["href"]


def scene_by_id(scenes: DataFrame, scene_id: str) -> DataFrame:
    return scenes.where(c("scene_id") == scene_id)


def boxes_meet(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return ((a["min_lon"] <= b["max_lon"]) & (a["max_lon"] >= b["min_lon"])
            & (a["min_lat"] <= b["max_lat"]) & (a["max_lat"] >= b["min_lat"]))


def search(scenes: DataFrame, start: str, end: str, max_cloud: float = 20.0, max_items: int | None = None,
           box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """All scenes on the days start..end with strictly less cloud; a page of the newest if ``max_items`` asks for one.

    Dates and cloud are plain comparisons on columns, so they reach the Parquet scan.
    """
    first, after = datetime.fromisoformat(start[:10]), F.date_add(F.lit(end[:10]).cast("date"), 1).cast("timestamp_ntz")
    df = scenes.where((c("acquired_at") >= F.lit(first).cast("timestamp_ntz")) & (c("acquired_at") < after)
                      & (c("cloud_cover") < max_cloud))
    if box is not None:
        corners = dict(zip(("min_lon", "min_lat", "max_lon", "max_lat"), map(F.lit, box)))
        df = df.where(boxes_meet({k: c(k) for k in corners}, corners))
    return df if max_items is None else df.orderBy(c("acquired_at").desc(), "scene_id").limit(max_items)


def best_scenes(scenes: DataFrame, targets: DataFrame, window_days: int = 30, max_cloud: float = 20.0) -> DataFrame:
    """Best scene of every (area, target): fewest whole days away, then least cloud, then newest.

    ``targets`` has aoi_id and target_at; scenes carry aoi_id. All scenes of the window
    compete, in an aggregate that combines on the map side.
    """
    near = (scenes.join(targets, "aoi_id")
            .where((c("acquired_at") >= F.date_sub(c("target_at").cast("date"), window_days).cast("timestamp_ntz"))
                   & (c("acquired_at") < F.date_add(c("target_at").cast("date"), window_days + 1).cast("timestamp_ntz"))
                   & (c("cloud_cover") < max_cloud)))
    seconds = F.unix_micros(c("acquired_at").cast("timestamp")) - F.unix_micros(c("target_at").cast("timestamp"))
    near = near.withColumn("days_off", F.abs(F.floor(seconds / 86400000000)).cast("int"))
    return first_by(near, ["aoi_id", "target_at"],
                    [c("days_off"), c("cloud_cover"), -F.unix_micros(c("acquired_at").cast("timestamp")), c("scene_id")])


def scene_pairs(scenes: DataFrame, targets: DataFrame, window_days: int = 30, max_cloud: float = 20.0) -> DataFrame:
    """Before and after scene per area; a side without a scene stays null, complete tells whether both exist.

    ``targets`` has aoi_id, before_at and after_at.
    """
    side = lambda name: best_scenes(scenes, targets.select("aoi_id", c(f"{name}_at").alias("target_at")), window_days, max_cloud).select(
        "aoi_id", c("scene_id").alias(f"{name}_scene_id"), c("acquired_at").alias(f"{name}_acquired_at"))
    both = side("before").join(side("after"), "aoi_id", "full")
    return both.withColumn("complete", c("before_scene_id").isNotNull() & c("after_scene_id").isNotNull())
