"""Read-only views for map and reporting tools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landwatch.functions.geometry import to_wkt

c = F.col


def asset_views(assets: DataFrame) -> dict[str, DataFrame]:
    """Assets split by geometry kind, as map tools take one kind per layer; multi-geometries are in none."""
    kind = c("geometry.type")
    return {"polygons": assets.where(kind == "Polygon"), "lines": assets.where(kind == "LineString"),
            "points": assets.where(kind == "Point")}


def risk_event_view(events: DataFrame, changes: DataFrame) -> DataFrame:
    """Events that have a change, with its geometry and measures."""
    return events.join(changes, "change_id")


def register_views(tables: dict[str, DataFrame], prefix: str = "v_") -> list[str]:
    """Register the six views in the session; returns their names."""
    split = asset_views(tables["assets"])
    frames = {"areas_of_interest": tables["areas"], "change_polygons": tables["changes"].withColumn("wkt", to_wkt(c("geometry"))),
              "risk_events": risk_event_view(tables["risk_events"], tables["changes"]),
              **{f"assets_{k}": df for k, df in split.items()}}
    for name, df in frames.items():
        df.createOrReplaceTempView(prefix + name)
    return [prefix + n for n in frames]
