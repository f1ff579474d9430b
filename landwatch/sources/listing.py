"""Stored objects under area/scene/file, area/run/file and area/source/file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col
PRODUCTS = {"dtm": "dtm.tif", "dsm": "dsm.tif", "chm": "chm.tif", "metadata": "metadata.json"}  # fixed values


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Listing of a folder tree (path below the root, size, time); file contents are never read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace("path", r"^.*?" + root.rstrip("/").replace(".", r"\.") + "/", "")
    return raw.select(rel.alias("path"), c("length").alias("size_bytes"), c("modificationTime").alias("modified_at"))


def with_prefix(objects: DataFrame, prefix: str) -> DataFrame:
    return objects.where(c("path").startswith(prefix))


def located(objects: DataFrame) -> DataFrame:
    """Add area, scene and file name; a path without folders belongs to scene "unknown"."""
    parts = F.split("path", "/")
    return objects.withColumns({"aoi_id": F.get(parts, F.lit(0)), "scene_id": F.coalesce(F.get(parts, F.lit(1)), F.lit("unknown")),
                                "file_name": F.element_at(parts, -1)})


def scene_files(objects: DataFrame) -> DataFrame:
    """Band files per scene, one row each: the file list in long form, for scenes with any number of files."""
    return located(objects).where(F.lower("path").endswith(".tif"))


def scene_list(objects: DataFrame) -> DataFrame:
    """Scenes with their number of files, bytes and newest time; sort by modified_at for display."""
    return scene_files(objects).groupBy("aoi_id", "scene_id").agg(
        F.count("*").alias("file_count"), F.sum("size_bytes").alias("size_bytes"), F.max("modified_at").alias("modified_at"))


def scene_details(objects: DataFrame, areas: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Per scene: bounds of the sidecar, else of the area, and the file to display, PNG before TIFF.

    ``sidecars`` has path and the text of <area>/<scene>/rgb.bounds.json; an unreadable one is ignored.
    """
    image = located(objects).where(F.lower("path").rlike(r"\.(tif|png)$"))
    is_png = F.lower("file_name").endswith(".png")
    scenes = image.groupBy("aoi_id", "scene_id").agg(
        F.count("*").alias("file_count"), F.max("modified_at").alias("modified_at"), F.min_by("path", F.struct(~is_png, "path")).alias("display_path"))
    side = located(sidecars).where(c("file_name") == "rgb.bounds.json").select(
        "aoi_id", "scene_id", F.coalesce(F.from_json(F.get_json_object("text", "$.bounds"), "array<double>"),
                                         F.from_json(F.get_json_object("text", "$.Bounds"), "array<double>")).alias("_b"))
    box = areas.select("aoi_id", F.array("min_lon", "min_lat", "max_lon", "max_lat").alias("_area"))
    return (scenes.join(side, ["aoi_id", "scene_id"], "left").join(box, "aoi_id")
            .withColumn("bounds", F.when(F.size("_b") == 4, c("_b")).otherwise(c("_area"))).drop("_b", "_area"))


def terrain_listing(objects: DataFrame) -> DataFrame:
    """Per terrain source: where its products and metadata lie, and the newest time."""
    named = F.lower("file_name")
    return located(objects).groupBy("aoi_id", c("scene_id").alias("source_id")).agg(
        *[F.max(F.when(named == f, c("path"))).alias(f"{k}_path") for k, f in PRODUCTS.items()],
        F.count("*").alias("file_count"), F.max("modified_at").alias("modified_at"))


METADATA = ("source_id string, point_count bigint, point_density_per_m2 double, crs_epsg int, resolution_m double, "
            "bounds array<double>, classification_counts map<string,bigint>")


def terrain_metadata(texts: DataFrame) -> DataFrame:
    """Product metadata of metadata.json texts (path, text); class codes become numbers again."""
    m = F.from_json("text", METADATA)
    counts = F.transform_keys(m["classification_counts"], lambda k, v: k.cast("int"))
    return located(texts).select("aoi_id", c("scene_id").alias("source_id"), m["point_count"].alias("point_count"),
                                 m["point_density_per_m2"].alias("point_density_per_m2"), m["crs_epsg"].alias("crs_epsg"),
                                 m["resolution_m"].alias("resolution_m"), m["bounds"].alias("bounds"), counts.alias("classification_counts"))


def write_artifacts(df: DataFrame, root: str, *levels: str) -> None:
    """Rows under area / scene, run or source folders."""
    df.write.mode("overwrite").partitionBy(*levels).parquet(root)
