"""Structured query plans."""

from pyspark.sql import functions as F

from landwatch.catalogue.registry import query
from landwatch.functions import geometry as G
from landwatch.plans import executor as E
from landwatch.plans.query_plan import load_plan

c = F.col
V = "stored_events stored_changes stored_runs assets"
JOINED = """j AS (SELECT e.*, ch.run_id, ch.change_type, r.aoi_id, a.name AS asset_name, a.asset_type FROM stored_events e
LEFT JOIN stored_changes ch ON e.change_id = ch.change_id LEFT JOIN stored_runs r ON ch.run_id = r.run_id LEFT JOIN assets a ON e.asset_id = a.asset_id)"""


def tables(t):
    h = c("half_size_deg")
    return {"risk_events": t.stored_events, "runs": t.stored_runs,
            "changes": t.stored_changes.withColumn("geometry", G.box(c("lon") - h, c("lat") - h, c("lon") + h, c("lat") + h)),
            "assets": t.assets.withColumn("geometry", G.point(c("lon"), c("lat")))}


def answer(t, plan):
    return E.execute_plan(tables(t), load_plan(plan))


CRITICAL_NEAR = {
    "targetEntity": "RiskEvent", "aoiId": "aoi-1", "limit": 500,
    "filters": [{"property": "RiskLevel", "operator": "gte", "value": "high"}, {"property": "DistanceMeters", "operator": "lt", "value": 1200},
                {"property": "Colour", "operator": "eq", "value": "red"}, {"property": "RiskScore", "operator": "gt", "value": "many"}]}


@query(V, f"""WITH {JOINED} SELECT risk_event_id, risk_score, risk_level, distance_meters FROM j WHERE aoi_id = 'aoi-1' AND risk_level >= 2
AND distance_meters < 1200 ORDER BY risk_score DESC, created_at DESC, risk_event_id LIMIT 500""")
def plan_events_by_level(t):
    """Unknown properties and unreadable values drop out; the plan's own limit holds."""
    return answer(t, CRITICAL_NEAR).items.select("risk_event_id", "risk_score", "risk_level", "distance_meters")


@query(V, f"""WITH {JOINED} SELECT count(*) AS total FROM j WHERE aoi_id = 'aoi-1' AND risk_level >= 2 AND distance_meters < 1200""")
def plan_events_total(t):
    return answer(t, CRITICAL_NEAR).total


@query(V, f"""WITH {JOINED} SELECT risk_event_id, asset_id, distance_meters, asset_name FROM j WHERE distance_meters <= 500 AND asset_type = 6
AND created_at >= TIMESTAMP '1996-01-01' AND created_at <= TIMESTAMP '1998-12-31'""")
def plan_events_near_hospitals(t):
    """Within a distance of an asset type, in a closed date range, all of them."""
    return answer(t, {
        "targetEntity": "RiskEvent", "orderBy": "DistanceMeters", "orderDescending": False,
        "spatialFilter": {"operation": "within_distance", "referenceEntityType": "Asset", "distanceMeters": 500,
                          "referenceFilters": [{"property": "AssetType", "operator": "eq", "value": "hospital"}]},
        "dateRange": {"property": "DetectedAt", "from": "1996-01-01T00:00:00Z", "to": "1998-12-31T00:00:00Z"},
    }).items.select("risk_event_id", "asset_id", "distance_meters", "asset_name")


@query(V, f"""WITH {JOINED} SELECT count(*) AS total FROM j WHERE asset_type = 7 AND risk_score = 40""")
def plan_spatial_no_op(t):
    """intersects changes nothing, an unknown operator on a number means equality."""
    return answer(t, {
        "targetEntity": "RiskEvent", "spatialFilter": {"operation": "intersects", "referenceEntityType": "Asset", "distanceMeters": 5},
        "filters": [{"property": "AssetType", "operator": "neq", "value": "School"}, {"property": "RiskScore", "operator": "in", "value": [40]}],
    }).total


@query(V, """SELECT c.change_id, area_sq_meters, slope_degree_mean, CASE change_type WHEN 6 THEN 'LandslideDebris' END AS change_type_name,
(SELECT count(*) FROM stored_events e WHERE e.change_id = c.change_id) AS risk_event_count
FROM stored_changes c WHERE change_type = 6 AND coalesce(slope_degree_mean, 0) <= 20 AND coalesce(ml_confidence, 0) >= 0.5 AND ndvi_drop_max > -0.7
ORDER BY ndvi_drop_mean, change_id LIMIT 120""")
def plan_landslide_changes(t):
    return answer(t, {
        "targetEntity": "ChangePolygon", "orderBy": "NdviDropMean", "orderDescending": False, "limit": 120,
        "filters": [{"property": "ChangeType", "operator": "eq", "value": "LandslideDebris"},
                    {"property": "SlopeDegreeMean", "operator": "lte", "value": "20"},
                    {"property": "MlConfidence", "operator": "gte", "value": "0.5"},
                    {"property": "NdviDropMax", "operator": "gt", "value": "-0.7"}],
    }).items.select("change_id", "area_sq_meters", "slope_degree_mean", "change_type_name", "risk_event_count")


@query(V, """SELECT asset_id, name, CASE criticality WHEN 2 THEN 'High' WHEN 3 THEN 'Critical' END AS criticality_name FROM assets
WHERE criticality >= 2 AND contains(name, '#00000012')""")
def plan_assets_by_name(t):
    return answer(t, {
        "targetEntity": "Asset", "orderBy": "Name",
        "filters": [{"property": "Criticality", "operator": "gte", "value": "2"}, {"property": "Name", "operator": "eq", "value": "#00000012"},
                    {"property": "SourceDataset", "operator": "eq", "value": "ignored"}],
    }).items.select("asset_id", "name", "criticality_name")


@query(V, """SELECT run_id, aoi_id, status, before_date FROM stored_runs WHERE status = 5""")
def plan_completed_runs(t):
    return answer(t, '{"targetEntity": "ProcessingRun", "orderBy": "beforeDate", "orderDescending": false,'
                     ' "filters": [{"property": "Status", "operator": "eq", "value": "completed"}]}').items.select(
        "run_id", "aoi_id", "status", "before_date")


@query(V, f"""WITH {JOINED}, page AS (SELECT risk_event_id, asset_id, risk_score FROM j WHERE risk_level = 3 ORDER BY risk_score DESC, created_at DESC, risk_event_id LIMIT 700)
SELECT risk_event_id, 'Feature' AS kind, 'Polygon' AS geometry_type, 5 AS vertex_count, asset_id, risk_score FROM page""")
def plan_event_features(t):
    """Map features of a plan's page, read back from their GeoJSON texts."""
    f = answer(t, {"targetEntity": "RiskEvent", "limit": 700, "filters": [{"property": "RiskLevel", "operator": "eq", "value": "Critical"}]}).features
    g = G.from_geojson(F.get_json_object("feature", "$.geometry"))
    return f.select("risk_event_id", F.get_json_object("feature", "$.type").alias("kind"), g["type"].alias("geometry_type"),
                    F.size(G.vertices(g)).alias("vertex_count"),
                    F.get_json_object("feature", "$.properties.assetId").alias("asset_id"),
                    F.get_json_object("feature", "$.properties.riskScore").cast("int").alias("risk_score"))


@query("aois", """SELECT 'aoi-3' AS by_id, (SELECT aoi_id FROM aois WHERE lower(name) = 'asia') AS by_name,
(SELECT min(aoi_id) FROM aois WHERE lower(name) LIKE '%eur%') AS by_part, 'aoi-0' AS by_request""")
def area_scope(t):
    """Area meant by a text: id, whole name, part of a name, or the request's own area."""
    ask = lambda text, out, own=None: E.resolve_area(t.aois, text, own).withColumnRenamed("aoi_id", out)
    return (ask("aoi-3", "by_id").crossJoin(ask("asia", "by_name")).crossJoin(ask("Eur", "by_part"))
            .crossJoin(ask("atlantis", "by_request", "aoi-0")))
