"""Turns a structured plan into one lazy DataFrame per answer: total, items and map features."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landwatch.functions.geometry import to_geojson
from landwatch.plans.query_plan import AttributeFilter, QueryPlan, as_float, as_int
from landwatch.schema import (
    ASSET_TYPES, CHANGE_TYPES, CRITICALITIES, RISK_LEVELS, RUN_STATUSES, name_of, parse_code)

COMPARE = {
    "eq": lambda c, v: c == v, "neq": lambda c, v: c != v, "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v,
}


@dataclass
class Answer:
    total: DataFrame  # one row, one column: total
    items: DataFrame
    features: DataFrame | None  # one GeoJSON feature text per row; runs have none


def numeric(col: Column, op: str, value) -> Column | None:
    """Comparison by operator name; an unknown one compares for equality, no value drops the filter."""
    return None if value is None else COMPARE.get(op, COMPARE["eq"])(col, F.lit(value))


def _coded(col: Column, codes: dict[str, int], f: AttributeFilter, ops=("eq", "gte")) -> Column | None:
    code = parse_code(codes, f.value)
    if code is None or f.operator not in ops:
        return None
    return COMPARE[f.operator](col, F.lit(code))


def _always_equal(col: Column, codes: dict[str, int], f: AttributeFilter) -> Column | None:
    code = parse_code(codes, f.value)
    return None if code is None else col == F.lit(code)


c = F.col
# Per entity: the properties a filter may name. Any other property is ignored.
FILTERS = {
    "RiskEvent": {
        "riskscore": lambda f: numeric(c("risk_score"), f.operator, as_int(f.value)),
        "risklevel": lambda f: _coded(c("risk_level"), RISK_LEVELS, f),
        "distancemeters": lambda f: numeric(c("distance_meters"), f.operator, as_float(f.value)),
        "assettype": lambda f: _always_equal(c("asset_type"), ASSET_TYPES, f),
    },
    "ChangePolygon": {
        "areasqmeters": lambda f: numeric(c("area_sq_meters"), f.operator, as_float(f.value)),
        "ndvidropmean": lambda f: numeric(c("ndvi_drop_mean"), f.operator, as_float(f.value)),
        "ndvidropmax": lambda f: numeric(c("ndvi_drop_max"), f.operator, as_float(f.value)),
        "changetype": lambda f: _always_equal(c("change_type"), CHANGE_TYPES, f),
        "slopedegreemean": lambda f: numeric(F.coalesce("slope_degree_mean", F.lit(0.0)), f.operator, as_float(f.value)),
        "mlconfidence": lambda f: numeric(F.coalesce("ml_confidence", F.lit(0.0)), f.operator, as_float(f.value)),
    },
    "Asset": {
        "assettype": lambda f: _always_equal(c("asset_type"), ASSET_TYPES, f),
        "criticality": lambda f: _coded(c("criticality"), CRITICALITIES, f),
        "name": lambda f: c("name").contains(f.value),
    },
    "ProcessingRun": {"status": lambda f: _always_equal(c("status"), RUN_STATUSES, f)},
}
# Date column, primary key, order columns by property, and the order used otherwise.
SHAPE = {
    "RiskEvent": ("created_at", "risk_event_id",
                  {"riskscore": "risk_score", "distancemeters": "distance_meters", "createdat": "created_at"},
                  ["risk_score", "created_at"]),
    "ChangePolygon": ("detected_at", "change_id",
                      {"areasqmeters": "area_sq_meters", "ndvidropmean": "ndvi_drop_mean", "detectedat": "detected_at"},
                      ["area_sq_meters"]),
    "Asset": ("created_at", "asset_id", {"criticality": "criticality", "name": "name", "createdat": "created_at"},
              ["criticality"]),
    "ProcessingRun": ("created_at", "run_id", {"beforedate": "before_date", "afterdate": "after_date"}, ["created_at"]),
}


def _where(df: DataFrame, entity: str, filters: list[AttributeFilter]) -> DataFrame:
    for f in filters:
        build = FILTERS[entity].get(f.property.lower())
        test = build(f) if build else None
        df = df if test is None else df.where(test)
    return df


def _reference_assets(assets: DataFrame, filters: list[AttributeFilter]) -> DataFrame:
    kept = [f for f in filters if f.property.lower() == "assettype"]
    tests = [t for t in (_always_equal(c("asset_type"), ASSET_TYPES, f) for f in kept) if t is not None]
    return assets.where(reduce(Column.__and__, tests)) if tests else assets


def _events_near(df: DataFrame, assets: DataFrame, plan: QueryPlan) -> DataFrame:
    """Keep events whose own asset is of the wanted type and whose stored distance is in reach.

    Only within_distance to assets is defined; every other spatial filter changes nothing.
    """
    s = plan.spatial_filter
    if not s or s.operation != "within_distance" or s.distance_meters is None or s.reference_entity_type != "Asset":
        return df
    wanted = _reference_assets(assets, s.reference_filters).select("asset_id")
    return df.join(wanted, "asset_id", "left_semi").where(c("distance_meters") <= float(s.distance_meters))


def _joined(tables: dict[str, DataFrame], entity: str) -> DataFrame:
    runs = lambda: tables["runs"].select("run_id", c("aoi_id").alias("run_aoi_id"))
    if entity == "RiskEvent":
        change_cols = [k for k in ("change_id", "run_id", "change_type", "geometry") if k in tables["changes"].columns]
        changes = tables["changes"].select(*change_cols).join(runs(), "run_id", "left")
        changes = changes.withColumnsRenamed({"run_aoi_id": "aoi_id"})
        assets = tables["assets"].select("asset_id", c("name").alias("asset_name"), "asset_type")
        return tables["risk_events"].join(changes, "change_id", "left").join(assets, "asset_id", "left")
    if entity == "ChangePolygon":
        return tables["changes"].drop("aoi_id").join(runs(), "run_id", "left").withColumnRenamed("run_aoi_id", "aoi_id")
    return tables["assets" if entity == "Asset" else "runs"]


def _features(items: DataFrame, entity: str) -> DataFrame | None:
    if "geometry" not in items.columns:
        return None
    key = SHAPE[entity][1]
    named = {
        "RiskEvent": {"riskEventId": "risk_event_id", "changePolygonId": "change_id", "assetId": "asset_id",
                      "assetName": "asset_name", "assetTypeName": "asset_type_name", "changeTypeName": "change_type_name",
                      "riskScore": "risk_score", "riskLevelName": "risk_level_name", "distanceMeters": "distance_meters",
                      "createdAt": "created_at"},
        "ChangePolygon": {"changePolygonId": "change_id", "areaSqMeters": "area_sq_meters",
                          "ndviDropMean": "ndvi_drop_mean", "changeTypeName": "change_type_name",
                          "detectedAt": "detected_at"},
        "Asset": {"assetId": "asset_id", "name": "name", "assetTypeName": "asset_type_name",
                  "criticalityName": "criticality_name"},
    }[entity]
    return features(items.where(c("geometry").isNotNull()), key, {k: v for k, v in named.items() if v in items.columns})


def features(df: DataFrame, key: str, properties: dict[str, str]) -> DataFrame:
    """One GeoJSON feature text per row."""
    props = F.to_json(F.struct(*[c(col).alias(name) for name, col in properties.items()]), {"ignoreNullFields": "false"})
    text = F.concat(F.lit('{"type":"Feature","id":"'), c(key), F.lit('","geometry":'), to_geojson(c("geometry")),
                    F.lit(',"properties":'), props, F.lit("}"))
    return df.select(c(key), text.alias("feature"))


def _named(df: DataFrame, entity: str) -> DataFrame:
    if entity == "RiskEvent":
        return df.withColumns({
            "asset_name": F.coalesce("asset_name", F.lit("Unknown")),
            "asset_type_name": F.coalesce(name_of(ASSET_TYPES, c("asset_type")), F.lit("Unknown")),
            "risk_level_name": name_of(RISK_LEVELS, c("risk_level")),
            "change_type_name": name_of(CHANGE_TYPES, c("change_type"))})
    if entity == "ChangePolygon":
        return df.withColumn("change_type_name", name_of(CHANGE_TYPES, c("change_type")))
    if entity == "Asset":
        return df.withColumns({"asset_type_name": name_of(ASSET_TYPES, c("asset_type")),
                               "criticality_name": name_of(CRITICALITIES, c("criticality"))})
    return df.withColumn("status_name", name_of(RUN_STATUSES, c("status")))


def matching(tables: dict[str, DataFrame], plan: QueryPlan) -> DataFrame:
    """All rows a plan selects, before order and limit."""
    entity = plan.target_entity
    df = _joined(tables, entity)
    if plan.aoi_id:
        df = df.where(c("aoi_id") == plan.aoi_id)
    df = _where(df, entity, plan.filters)
    if entity == "RiskEvent":
        df = _events_near(df, tables["assets"], plan)
    if plan.date_range:
        at = c(SHAPE[entity][0])
        if plan.date_range.start:
            df = df.where(at >= F.lit(plan.date_range.start))
        if plan.date_range.end:
            df = df.where(at <= F.lit(plan.date_range.end))
    return df


def execute_plan(tables: dict[str, DataFrame], plan: QueryPlan) -> Answer:
    """Total before paging, the items, and their map features.

    ``tables`` holds risk_events, changes, runs and assets. A plan with a limit gets its ordered page
    and the primary key is always the last sort key, so a page is the same on every run; a plan
    without one gets all rows.
    """
    entity = plan.target_entity
    _, key, order_cols, default = SHAPE[entity]
    df = matching(tables, plan)
    total = df.agg(F.count("*").alias("total"))
    named = order_cols.get((plan.order_by or "").lower())
    if named is None:
        order = [c(k).desc() for k in default]
    else:
        order = [c(named).desc() if plan.order_descending else c(named).asc()]
    items = _named(df if plan.limit is None else df.orderBy(*order, c(key)).limit(max(0, plan.limit)), entity)
    if entity == "ChangePolygon" and "risk_events" in tables:
        counts = (tables["risk_events"].join(items.select("change_id"), "change_id", "left_semi")
                  .groupBy("change_id").agg(F.count("*").alias("risk_event_count")))
        items = (items.join(counts, "change_id", "left")
                 .withColumn("risk_event_count", F.coalesce("risk_event_count", F.lit(0)).cast("long")))
    return Answer(total, items, _features(items, entity))


def resolve_area(areas: DataFrame, wanted: str, request_aoi_id: str | None = None) -> DataFrame:
    """One row with the area a text means: exact id, else equal name, else a name containing it.

    Names compare in any case; the request's own area is used when nothing matches.
    """
    name, want = F.lower("name"), wanted.lower()
    step = F.when(c("aoi_id") == wanted, 1).when(name == want, 2).when(F.contains(name, F.lit(want)), 3)
    best = F.min_by("aoi_id", F.when(step.isNotNull(), F.struct(step.alias("step"), c("aoi_id").alias("id"))))
    return areas.where(step.isNotNull()).agg(F.coalesce(best, F.lit(request_aoi_id)).alias("aoi_id"))
