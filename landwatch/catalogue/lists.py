"""Lists, counts, triage and alerts over stored entities."""

from pyspark.sql import functions as F

from landwatch.catalogue.registry import query
from landwatch.catalogue.sqltext import ASSET_TYPE, LEVEL_NAME, STATUS
from landwatch.operators import lists as L
from landwatch.schema import ASSET_TYPES, CHANGE_TYPES, CRITICALITIES, RISK_LEVELS, name_of

c = F.col
EVENT_RUN = """er AS (SELECT e.*, ch.run_id, r.aoi_id FROM stored_events e LEFT JOIN stored_changes ch ON e.change_id = ch.change_id
  LEFT JOIN stored_runs r ON ch.run_id = r.run_id)"""
V = "stored_events stored_changes stored_runs"
SUMMARY = f"""sm AS (SELECT e.*, coalesce(a.name, 'Unknown') AS asset_name, coalesce({ASSET_TYPE.format('a.asset_type')}, 'Unknown') AS asset_type_name,
  {LEVEL_NAME.format('risk_level')} AS risk_level_name, acknowledged_at IS NOT NULL AS is_acknowledged, dismissed_at IS NOT NULL AS is_dismissed
  FROM stored_events e LEFT JOIN assets a ON e.asset_id = a.asset_id)"""


def events(t):
    return L.with_run(t.stored_events, t.stored_changes, t.stored_runs)


@query(V, f"""WITH {EVENT_RUN} SELECT risk_event_id, risk_score, risk_level, distance_meters, created_at FROM er
WHERE aoi_id = 'aoi-1' AND risk_score >= 40 AND acknowledged_at IS NULL AND dismissed_at IS NULL""")
def events_by_area_and_score(t):
    return L.list_events(events(t), aoi_id="aoi-1", min_score=40, acknowledged=False).select(
        "risk_event_id", "risk_score", "risk_level", "distance_meters", "created_at")


@query(V, f"""WITH {EVENT_RUN} SELECT risk_event_id, asset_id, run_id, dismissed_at FROM er
WHERE risk_level = 2 AND dismissed_at IS NOT NULL AND acknowledged_at IS NULL AND run_id = 'run-2-5'""")
def dismissed_events_of_run(t):
    return L.list_events(events(t), level=2, run_id="run-2-5", acknowledged=False, dismissed=True).select(
        "risk_event_id", "asset_id", "run_id", "dismissed_at")


@query(V, f"""WITH {EVENT_RUN} SELECT risk_event_id, risk_score, created_at FROM er WHERE aoi_id = 'aoi-2' AND dismissed_at IS NULL
ORDER BY risk_score DESC, created_at DESC, risk_event_id LIMIT 100 OFFSET 50""")
def events_page(t):
    """Second page of an area's events, highest score first, then newest."""
    return L.page(L.list_events(events(t), aoi_id="aoi-2"), [c("risk_score").desc(), c("created_at").desc()],
                  "risk_event_id", 100, 50).select("risk_event_id", "risk_score", "created_at")


@query(V, """SELECT risk_event_id, risk_score, created_at FROM stored_events WHERE dismissed_at IS NULL
ORDER BY risk_score DESC, created_at DESC, risk_event_id LIMIT 500 OFFSET 20000""")
def events_deep_page(t):
    """A page far down the whole event list, found by the counts of ranges."""
    return L.page(L.list_events(t.stored_events), [c("risk_score").desc(), c("created_at").desc()],
                  "risk_event_id", 500, 20_000).select("risk_event_id", "risk_score", "created_at")


@query(V, """SELECT risk_event_id, risk_level, dismissed_at FROM stored_events WHERE acknowledged_at IS NULL AND risk_level >= 2""")
def unacknowledged_events(t):
    return L.unacknowledged(t.stored_events, 2).select("risk_event_id", "risk_level", "dismissed_at")


@query(V, """SELECT risk_event_id, created_at, risk_score FROM stored_events WHERE asset_id = 'asset-7' AND dismissed_at IS NULL
ORDER BY created_at DESC, risk_event_id LIMIT 50""")
def events_of_asset(t):
    return L.page(L.list_events(t.stored_events, asset_id="asset-7"), [c("created_at").desc()], "risk_event_id", 50).select(
        "risk_event_id", "created_at", "risk_score")


@query(V, f"""WITH {EVENT_RUN} SELECT risk_event_id, run_id, risk_score FROM er WHERE run_id = 'run-1-1'""")
def events_of_run(t):
    return events(t).where(c("run_id") == "run-1-1").orderBy(c("risk_score").desc(), "risk_event_id").select(
        "risk_event_id", "run_id", "risk_score")


@query("assets", f"""SELECT asset_id, name, asset_type, {ASSET_TYPE.format('asset_type')} AS asset_type_name FROM assets
WHERE aoi_id = 'aoi-1' AND asset_type = 4 AND criticality = 2 ORDER BY asset_id LIMIT 5000 OFFSET 5""")
def assets_page(t):
    return L.list_assets(t.assets, "aoi-1", 4, 2, skip=5, take=5000).select(
        "asset_id", "name", "asset_type", name_of(ASSET_TYPES, c("asset_type")).alias("asset_type_name"))


@query("assets", """SELECT asset_id, name, criticality FROM assets WHERE aoi_id = 'aoi-3' AND asset_type = 6""")
def area_assets(t):
    return t.assets.where((c("aoi_id") == "aoi-3") & (c("asset_type") == ASSET_TYPES["Hospital"])).select(
        "asset_id", "name", "criticality")


@query(V, f"""SELECT r.run_id, r.aoi_id, status, {STATUS.format('status')} AS status_name, count(DISTINCT ch.change_id) AS change_count,
count(e.risk_event_id) AS event_count FROM stored_runs r LEFT JOIN stored_changes ch ON r.run_id = ch.run_id
LEFT JOIN stored_events e ON e.change_id = ch.change_id GROUP BY ALL""")
def run_list(t):
    """Runs with their numbers of changes and events."""
    from landwatch.schema import RUN_STATUSES
    return L.run_counts(t.stored_runs, t.stored_changes, t.stored_events).select(
        "run_id", "aoi_id", "status", name_of(RUN_STATUSES, c("status")).alias("status_name"), "change_count", "event_count")


@query("aois", """SELECT aoi_id, name, processing_schedule FROM aois WHERE processing_enabled AND processing_schedule IS NOT NULL""")
def scheduled_areas(t):
    return t.aois.where(c("processing_enabled") & c("processing_schedule").isNotNull()).select(
        "aoi_id", "name", "processing_schedule")


@query(V + " assets", f"""WITH {SUMMARY} SELECT risk_event_id, asset_name, asset_type_name, risk_level_name, is_acknowledged, is_dismissed FROM sm""")
def event_summaries(t):
    return L.event_summary(t.stored_events, t.assets).select(
        "risk_event_id", "asset_name", "asset_type_name", "risk_level_name", "is_acknowledged", "is_dismissed")


@query(V + " assets", f"""WITH {EVENT_RUN}, {SUMMARY} SELECT sm.risk_event_id, risk_score FROM sm WHERE NOT is_dismissed AND risk_score >= 30
AND risk_level_name = 'Medium' AND asset_type_name = 'School' AND NOT is_acknowledged
AND risk_event_id IN (SELECT risk_event_id FROM er WHERE aoi_id <> 'aoi-4')""")
def triage_list(t):
    """Reviewer's list inside a query result."""
    inside = events(t).where(c("aoi_id") != "aoi-4")
    return L.triage(L.event_summary(t.stored_events, t.assets), inside, 30, "Medium", "School", False).select(
        "risk_event_id", "risk_score")


@query(V, """SELECT risk_level, count(*) AS event_count, max(risk_score) AS top_score FROM stored_events WHERE risk_level IN (2, 3) GROUP BY 1""")
def high_priority_counts(t):
    return L.high_priority(t.stored_events).groupBy("risk_level").agg(
        F.count("*").alias("event_count"), F.max("risk_score").alias("top_score"))


@query(V, f"""WITH {EVENT_RUN} SELECT risk_event_id, risk_score FROM er WHERE run_id = 'run-0-0' AND risk_level >= 2
ORDER BY risk_score DESC, risk_event_id LIMIT 5""")
def run_top_events(t):
    """The five highest high-level events of a run."""
    return L.page(L.high_priority(events(t).where(c("run_id") == "run-0-0")), [c("risk_score").desc()],
                  "risk_event_id", 5).select("risk_event_id", "risk_score")


@query(V, f"""SELECT risk_event_id, channel, risk_level, {LEVEL_NAME.format('risk_level')} AS level_name FROM
(SELECT *, 'webhook' AS channel FROM stored_events WHERE risk_level >= 3 UNION ALL SELECT *, 'email' FROM stored_events WHERE risk_level >= 2)""")
def alert_routing(t):
    """Events per alert channel; the level is read back from the payload."""
    a = L.alert_rows(t.stored_events, L.ALERT_LEVELS)
    return a.select("risk_event_id", "channel", "risk_level", F.get_json_object("payload", "$.riskLevel").alias("level_name"))


@query(V, f"""WITH {EVENT_RUN} SELECT aoi_id, count(*) AS total_events, count(*) FILTER (acknowledged_at IS NULL) AS unacknowledged_events,
count(*) FILTER (risk_level = 0) AS low_events, count(*) FILTER (risk_level = 1) AS medium_events, count(*) FILTER (risk_level = 2) AS high_events,
count(*) FILTER (risk_level = 3) AS critical_events, count(DISTINCT risk_level) AS levels_used FROM er GROUP BY aoi_id""")
def area_statistics(t):
    return L.level_map(L.area_statistics(events(t))).withColumn(
        "levels_used", F.size("by_risk_level").cast("long")).drop("by_risk_level")


@query("aois assets", """SELECT a.aoi_id, a.name, a.min_lon, a.max_lat, count(s.asset_id) AS asset_count FROM aois a
LEFT JOIN assets s ON a.aoi_id = s.aoi_id GROUP BY ALL""")
def areas_with_asset_counts(t):
    return L.counted(t.aois, t.assets, "aoi_id", "asset_count").select("aoi_id", "name", "min_lon", "max_lat", "asset_count")


@query(V, """SELECT c.change_id, area_sq_meters, count(e.risk_event_id) AS event_count FROM stored_changes c
LEFT JOIN stored_events e ON e.change_id = c.change_id GROUP BY ALL""")
def changes_with_event_counts(t):
    return L.counted(t.stored_changes, t.stored_events, "change_id", "event_count").select(
        "change_id", "area_sq_meters", "event_count")


@query("aois assets", """SELECT 'aois' AS table_name, count(*) AS row_count FROM aois UNION ALL SELECT 'assets', count(*) FROM assets""")
def table_counts(t):
    return L.table_counts({"aois": t.aois, "assets": t.assets})


@query("assets " + V, f"""WITH {SUMMARY} SELECT string_agg(DISTINCT asset_type_name, ',' ORDER BY asset_type_name) AS asset_types,
count(*) FILTER (NOT is_acknowledged) AS unacknowledged FROM sm""")
def asset_types_in_events(t):
    s = L.event_summary(t.stored_events, t.assets)
    return s.agg(F.array_join(F.array_sort(F.collect_set("asset_type_name")), ",").alias("asset_types"),
                 F.count_if(~c("is_acknowledged")).alias("unacknowledged"))


@query(V, f"""SELECT run_id, {STATUS.format('status')} AS status_name, CAST(CASE WHEN status = 6 THEN -1 ELSE status END AS INT) AS step_index,
status BETWEEN 1 AND 4 AS in_progress, CASE WHEN status = 6 THEN 'pending' WHEN status > 3 THEN 'completed' WHEN status = 3 THEN 'active'
ELSE 'pending' END AS step_detectingchanges FROM stored_runs""")
def run_progress(t):
    return L.run_progress(t.stored_runs).select("run_id", "status_name", "step_index", "in_progress", "step_detectingchanges")


@query(V, """SELECT c.run_id, count(DISTINCT c.change_id) AS polygon_count, count(e.risk_event_id) AS risk_event_count,
bool_or(land_cover_class IS NOT NULL) AS has_land_cover, min(ml_model_version) AS ml_model_version
FROM stored_changes c LEFT JOIN stored_events e ON c.change_id = e.change_id GROUP BY c.run_id""")
def run_summaries(t):
    return L.run_summary(t.stored_changes, t.stored_events)


@query(V + " assets", f"""SELECT e.risk_event_id, ch.run_id, r.aoi_id, r.status, a.asset_type, a.criticality, ch.area_sq_meters, ch.change_type
FROM stored_events e LEFT JOIN stored_changes ch ON e.change_id = ch.change_id LEFT JOIN stored_runs r ON ch.run_id = r.run_id
LEFT JOIN assets a ON e.asset_id = a.asset_id""")
def event_details(t):
    """Events with change, run and asset."""
    return (events(t).drop("run_id", "aoi_id")
            .join(t.stored_changes.select("change_id", "run_id", "area_sq_meters", "change_type"), "change_id", "left")
            .join(t.stored_runs.select("run_id", "aoi_id", "status"), "run_id", "left")
            .join(t.assets.select("asset_id", "asset_type", "criticality"), "asset_id", "left")
            .select("risk_event_id", "run_id", "aoi_id", "status", "asset_type", "criticality", "area_sq_meters", "change_type"))


@query(V + " assets", """SELECT e.risk_event_id, ch.change_id, ch.lon, ch.lat, e.risk_score FROM stored_events e JOIN stored_changes ch ON e.change_id = ch.change_id""")
def event_change_view(t):
    """Risk events with the place of their change, read through the named view."""
    from landwatch.sources import views
    from landwatch.functions import geometry as G
    h = c("half_size_deg")
    ch = t.stored_changes.withColumn("geometry", G.box(c("lon") - h, c("lat") - h, c("lon") + h, c("lat") + h))
    v = views.risk_event_view(t.stored_events, ch)
    return v.select("risk_event_id", "change_id", "lon", "lat", "risk_score")


@query("assets", """SELECT asset_type, count(*) AS features FROM assets GROUP BY asset_type""")
def point_asset_view(t):
    """Point assets by type, through the view split by geometry kind."""
    from landwatch.functions import geometry as G
    from landwatch.sources import views
    v = views.asset_views(t.assets.withColumn("geometry", G.point(c("lon"), c("lat"))))
    return v["points"].groupBy("asset_type").agg(F.count("*").alias("features"))


@query("aois assets " + V, """SELECT a.aoi_id, a.name, min_lon, min_lat, max_lon, max_lat, count(s.asset_id) AS asset_count FROM aois a
LEFT JOIN assets s ON a.aoi_id = s.aoi_id WHERE a.aoi_id = 'aoi-1' GROUP BY ALL""")
def area_by_id(t):
    one = t.aois.where(c("aoi_id") == "aoi-1")
    return L.counted(one, t.assets.where(c("aoi_id") == "aoi-1"), "aoi_id", "asset_count").select(
        "aoi_id", "name", "min_lon", "min_lat", "max_lon", "max_lat", "asset_count")


@query(V, """SELECT c.change_id, c.run_id, area_sq_meters, (SELECT count(*) FROM stored_events e WHERE e.change_id = 'chg-77') AS event_count
FROM stored_changes c WHERE c.change_id = 'chg-77'""")
def change_by_id(t):
    same = c("change_id") == "chg-77"
    return L.counted(t.stored_changes.where(same), t.stored_events.where(same), "change_id", "event_count").select(
        "change_id", "run_id", "area_sq_meters", "event_count")
