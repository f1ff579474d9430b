"""Code tables and declared row types of the stored entities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Integer codes of the stored entities.
ASSET_TYPES = {
    "TransmissionLine": 0, "Substation": 1, "GasPipeline": 2, "Building": 3, "Road": 4,
    "FireStation": 5, "Hospital": 6, "School": 7, "WaterInfrastructure": 8, "Other": 99,
}
CHANGE_TYPES = {
    "Unknown": 0, "VegetationLoss": 1, "VegetationGain": 2, "FireBurnScar": 3,
    "DroughtStress": 4, "AgriculturalChange": 5, "LandslideDebris": 6,
}
CRITICALITIES = {"Low": 0, "Medium": 1, "High": 2, "Critical": 3}
RISK_LEVELS = {"Low": 0, "Medium": 1, "High": 2, "Critical": 3}
RUN_STATUSES = {
    "Pending": 0, "FetchingImagery": 1, "CalculatingNdvi": 2, "DetectingChanges": 3,
    "ScoringRisk": 4, "Completed": 5, "Failed": 6,
}
LAND_COVER_CLASSES = [
    "AnnualCrop", "Forest", "HerbaceousVegetation", "Highway", "Industrial",
    "Pasture", "PermanentCrop", "Residential", "River", "SeaLake",
]
SCENE_BANDS = [
    "B01", "B02", "B03", "B04", "B05", "B06", "B07", "B08", "B8A", "B09", "B10", "B11", "B12",
    "SCL", "visual",
]
LAND_COVER_BANDS = [
    "B01", "B02", "B03", "B04", "B05", "B06", "B07", "B08", "B09", "B10", "B11", "B12", "B8A",
]
LANDSLIDE_BANDS = [
    "B01", "B02", "B03", "B04", "B05", "B06", "B07", "B08", "B09", "B10", "B11", "B12",
]


def name_of(codes: dict[str, int], code: Column) -> Column:
    """Enumeration name of an integer code, null when the code is unknown."""
    return F.create_map(*[F.lit(v) for n, c in codes.items() for v in (c, n)])[code]


def code_of(codes: dict[str, int], name: Column) -> Column:
    """Integer code of an enumeration name, null when the name is unknown."""
    return F.create_map(*[F.lit(v) for n, c in codes.items() for v in (n, c)])[name]


def parse_code(codes: dict[str, int], value: str | None) -> int | None:
    """Code for a name in any case or for an integer text; anything else gives None."""
    if value is None:
        return None
    text = value.strip()
    for name, code in codes.items():
        if name.lower() == text.lower():
            return code
    try:
        return int(text)
    except ValueError:
        return None


PARTS = "array<array<array<struct<x:double,y:double>>>>"
GEOMETRY_DDL = f"struct<type:string,parts:{PARTS}>"


def geometry_type() -> T.DataType:
    """Geometry as parts -> rings -> points; a point is one part, one ring, one vertex."""
    xy = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
    parts = T.ArrayType(T.ArrayType(T.ArrayType(xy)))
    return T.StructType([T.StructField("type", T.StringType()), T.StructField("parts", parts)])


FACTOR = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("points", T.IntegerType()),
    T.StructField("max_points", T.IntegerType()), T.StructField("reason_code", T.StringType()),
    T.StructField("details", T.StringType()),
])


def _fields(spec: str) -> T.StructType:
    kinds = {"s": T.StringType(), "d": T.DoubleType(), "i": T.IntegerType(), "t": T.TimestampType(),
             "b": T.BooleanType(), "g": geometry_type(), "f": T.ArrayType(FACTOR),
             "m": T.MapType(T.StringType(), T.StringType())}
    out = []
    for item in spec.split():
        name, kind = item.split(":")
        out.append(T.StructField(name, kinds[kind.rstrip("!")], not kind.endswith("!")))
    return T.StructType(out)


AREA_ROWS = _fields(
    "aoi_id:s! name:s! description:s min_lon:d! min_lat:d! max_lon:d! max_lat:d! center_lon:d! "
    "center_lat:d! created_at:t! updated_at:t processing_schedule:s processing_enabled:b! "
    "last_processed_at:t default_lookback_days:i! max_cloud_cover:d! last_checked_at:t")
ASSET_ROWS = _fields(
    "asset_id:s! aoi_id:s! name:s! asset_type:i! geometry:g! criticality:i! properties:m "
    "source_dataset:s source_feature_id:s created_at:t! updated_at:t")
RUN_ROWS = _fields(
    "run_id:s! aoi_id:s! status:i! before_date:t! after_date:t! before_scene_id:s after_scene_id:s "
    "started_at:t completed_at:t error_message:s metadata:m created_at:t!")
CHANGE_ROWS = _fields(
    "change_id:s! run_id:s! geometry:g! area_sq_meters:d! ndvi_drop_mean:d! ndvi_drop_max:d! "
    "change_type:i! slope_degree_mean:d slope_degree_max:d aspect_degrees:d elevation_m:d "
    "land_cover_class:s detected_at:t! ml_confidence:d ml_model_version:s")
EVENT_ROWS = _fields(
    "risk_event_id:s! change_id:s! asset_id:s! distance_meters:d! risk_score:i! risk_level:i! "
    "scoring_factors:f created_at:t! notification_sent_at:t acknowledged_at:t acknowledged_by:s "
    "dismissed_at:t dismissed_by:s")
# Columns of a detected change before it is stored; an empty detection keeps them.
DETECTED_ROWS = _fields(
    "geometry:g area_sq_meters:d ndvi_drop_mean:d ndvi_drop_max:d change_type:s slope_degree_mean:d "
    "slope_degree_max:d aspect_degrees:d elevation_m:d land_cover_class:s ml_confidence:d "
    "ml_model_version:s")
