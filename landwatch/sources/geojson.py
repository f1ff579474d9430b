"""Feature collections: reading, checking and writing."""

from __future__ import annotations

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landwatch.functions import geometry as G
from landwatch.functions import kernels as K
from landwatch.functions import projection as P
from landwatch.plans.executor import features
from landwatch.schema import ASSET_TYPES, CHANGE_TYPES, CRITICALITIES, name_of
from landwatch.sources.split_json import array_elements

c = F.col
FEATURE = "struct<type:string,id:string,geometry:string,properties:map<string,string>>"


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """Features of collection files with their position in the file; one large file is read by many tasks.

    A missing path gives an empty frame.
    """
    empty = spark.createDataFrame([], f"seq bigint, feature {FEATURE}")
    try:
        texts = array_elements(spark, path, "features")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return feature_rows(empty, c("feature"), "seq")
    return feature_rows(texts.select("seq", F.from_json("text", FEATURE).alias("feature")), c("feature"), "seq")


def parse_features(df: DataFrame, text: str, seq: str) -> DataFrame:
    """Features of one JSON text per row."""
    return feature_rows(df.withColumn("feature", F.from_json(text, FEATURE)), c("feature"), seq)


def feature_rows(df: DataFrame, feature: Column, seq: str) -> DataFrame:
    return df.withColumns({"feature_id": F.coalesce(feature["id"], c(seq).cast("string")), "geometry": G.from_geojson(feature["geometry"]),
                           "properties": feature["properties"]}).drop("feature")


def check_geometry(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a geometry inside degree limits, the others with an error)."""
    error = lambda g: F.when(g.isNull(), "Invalid GeoJSON geometry").when(
        ~G.bound(F.array(*G.bounds(g)), lambda b: G.in_degrees(*[b[i] for i in range(4)])), "Coordinates outside WGS84 range")
    marked = df.withColumn("error", G.bound(c("geometry"), error))
    return marked.where(c("error").isNull()).drop("error"), marked.where(c("error").isNotNull())


def filter_to_box(df: DataFrame, dataset: str, seq: str, box: tuple[float, float, float, float], pad_deg: float = 0.0) -> DataFrame:
    """Features that meet a box in degrees; datasets in Web Mercator are recognised and brought to degrees.

    The first feature of a dataset tells its coordinates. Features without a usable geometry drop out.
    """
    x0, y0, x1, y1 = box[0] - pad_deg, box[1] - pad_deg, box[2] + pad_deg, box[3] + pad_deg
    lead = G.bounds(c("_g"))
    kind = (df.groupBy(dataset).agg(F.min_by("geometry", seq).alias("_g"))
            .select(dataset, F.coalesce(P.looks_mercator(lead[0], lead[1]), F.lit(False)).alias("_merc")))
    d = df.where(c("geometry").isNotNull()).join(kind, dataset)
    side = lambda deg, merc: F.when(c("_merc"), merc(F.lit(deg))).otherwise(F.lit(deg))
    hit = K.meets_box("geometry.type", "geometry.parts", side(x0, P.mercator_x), side(y0, P.mercator_y), side(x1, P.mercator_x), side(y1, P.mercator_y))
    moved = F.transform("geometry.parts", lambda p: F.transform(p, lambda r: F.transform(
        r, lambda v: G.vertex(P.mercator_lon(v["x"]), P.mercator_lat(v["y"])))))
    parts = F.when(c("_merc"), moved).otherwise(c("geometry.parts"))
    return d.where(hit).withColumn("geometry", G.geometry(c("geometry.type"), parts)).drop("_merc")


def asset_features(assets: DataFrame, aoi_id: str, asset_types: str | None = None, most: int | None = None) -> DataFrame:
    """Feature texts of an area's assets, optionally of a comma list of type codes; all, or the first ``most`` by id."""
    df = assets.where(c("aoi_id") == aoi_id)
    codes = [int(v) for v in (asset_types or "").split(",") if v.strip().isdigit()]
    df = df.where(c("asset_type").isin(codes)) if codes else df
    df = df if most is None else df.orderBy("asset_id").limit(most)
    named = df.withColumns({"asset_type_name": name_of(ASSET_TYPES, c("asset_type")), "criticality_name": name_of(CRITICALITIES, c("criticality"))})
    return features(named, "asset_id", {"name": "name", "assetType": "asset_type", "assetTypeName": "asset_type_name",
                                        "criticality": "criticality", "criticalityName": "criticality_name", "sourceDataset": "source_dataset"})


def change_features(changes: DataFrame, runs: DataFrame, aoi_id: str | None = None, run_id: str | None = None) -> DataFrame:
    """Feature texts of the changes of an area, of one run, or of one run of an area; one per row, no limit."""
    df = changes if run_id is None else changes.where(c("run_id") == run_id)
    if aoi_id is not None:
        df = df.join(runs.where(c("aoi_id") == aoi_id).select("run_id"), "run_id", "left_semi")
    named = df.withColumn("change_type_name", name_of(CHANGE_TYPES, c("change_type")))
    return features(named, "change_id", {"changePolygonId": "change_id", "areaSqMeters": "area_sq_meters", "ndviDropMean": "ndvi_drop_mean",
                                         "ndviDropMax": "ndvi_drop_max", "changeType": "change_type", "changeTypeName": "change_type_name", "detectedAt": "detected_at"})


def collection(capped: DataFrame, key: str) -> DataFrame:
    """One collection text of an already limited set of features (the export limit bounds the array)."""
    rows = F.array_sort(F.collect_list(F.struct(c(key).alias("k"), c("feature").alias("f"))))
    text = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.transform(rows, lambda r: r["f"]), ","), F.lit("]}"))
    return capped.agg(text.alias("collection"))


def write_features(df: DataFrame, path: str) -> None:
    """Features as text, one per line, in parallel files; the form for sets without a limit."""
    df.select(c("feature").alias("value")).write.mode("overwrite").text(path)


def write_collections(df: DataFrame, path: str) -> None:
    """Features as valid collection files, one a partition, each streamed with its frame around it."""
    def framed(batches):
        lead = '{"type":"FeatureCollection","features":['
        for batch in batches:
            rows = batch["value"].to_pylist()
            if rows:
                yield pa.RecordBatch.from_pydict({"value": [lead + rows[0], *["," + r for r in rows[1:]]]})
                lead = ","
        yield pa.RecordBatch.from_pydict({"value": ["]}" if lead == "," else lead + "]}"]})

    df.select(c("feature").alias("value")).mapInArrow(framed, "value string").write.mode("overwrite").text(path)


def submission(changes: DataFrame) -> DataFrame:
    """Detected changes as camel-case records with the type as a code, unknown names as 0."""
    from landwatch.schema import code_of
    return changes.select(
        G.to_geojson(c("geometry")).alias("geometry"), c("area_sq_meters").alias("areaSqMeters"), c("ndvi_drop_mean").alias("ndviDropMean"),
        c("ndvi_drop_max").alias("ndviDropMax"), F.coalesce(code_of(CHANGE_TYPES, c("change_type")), F.lit(0)).alias("changeType"),
        c("slope_degree_mean").alias("slopeDegreeMean"), c("slope_degree_max").alias("slopeDegreeMax"), c("aspect_degrees").alias("aspectDegrees"),
        c("elevation_m").alias("elevationM"), c("ml_confidence").alias("mlConfidence"), c("ml_model_version").alias("mlModelVersion"))
