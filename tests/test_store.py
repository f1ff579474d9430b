import datetime as dt
import json
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from landwatch.catalogue import ingest
from landwatch.operators import checks, lists, loads, state
from landwatch.plans import executor as E
from landwatch.plans.query_plan import lenient_text, load_plan
from landwatch.schema import DETECTED_ROWS, EVENT_ROWS, RUN_STATUSES
from landwatch.sources import assets as A
from landwatch.sources import geojson as J
from landwatch.sources import listing as L
from landwatch.sources import scenes as S
from landwatch.sources import views
from landwatch.streaming import jobs

c = F.col
T0 = dt.datetime(2024, 6, 1)


@pytest.fixture(scope="module")
def seed(spark):
    point = ("Point", [[[(0.0, 0.0)]]])
    from landwatch.schema import GEOMETRY_DDL as G
    return {
        "assets": spark.createDataFrame([("hospital-1", "test-aoi", "City Hospital", 6, 3, point, T0), ("school-1", "test-aoi", "School", 7, 2, point, T0),
                                         ("sub-1", "other-aoi", "Sub", 1, 2, point, T0)],
                                        f"asset_id string, aoi_id string, name string, asset_type int, criticality int, geometry {G}, created_at timestamp"),
        "runs": spark.createDataFrame([("run", "test-aoi", 5, dt.datetime(2024, 1, 1), T0, T0)], "run_id string, aoi_id string, status int, before_date timestamp, after_date timestamp, created_at timestamp"),
        "changes": spark.createDataFrame([("c1", "run", 8000.0, -0.35, -0.3, 6, None, T0, None, point), ("c2", "run", 3000.0, -0.2, -0.1, 1, 12.0, T0, None, None)],
                                         f"change_id string, run_id string, area_sq_meters double, ndvi_drop_mean double, ndvi_drop_max double, change_type int, slope_degree_mean double, detected_at timestamp, ml_confidence double, geometry {G}"),
        "risk_events": spark.createDataFrame([("e1", "c1", "hospital-1", 150.0, 85, 3, T0), ("e2", "c2", "school-1", 400.0, 45, 1, T0 + dt.timedelta(days=1))],
                                             "risk_event_id string, change_id string, asset_id string, distance_meters double, risk_score int, risk_level int, created_at timestamp"),
    }


def ask(seed, entity, **plan):
    return E.execute_plan(seed, load_plan({"targetEntity": entity, **plan}))


def ids(answer, key):
    return [r[key] for r in answer.items.collect()]


def test_plans_on_the_seeded_store(seed):
    f = lambda p, o, v: [{"property": p, "operator": o, "value": v}]
    assert ids(ask(seed, "RiskEvent"), "risk_event_id") == ["e1", "e2"]
    assert ids(ask(seed, "RiskEvent", filters=f("RiskLevel", "eq", "Critical")), "risk_event_id") == ["e1"]
    assert ids(ask(seed, "RiskEvent", filters=f("RiskLevel", "lt", "Critical")), "risk_event_id") == ["e1", "e2"], "only eq and gte filter levels"
    assert ids(ask(seed, "RiskEvent", filters=f("RiskScore", "gte", 50.0)), "risk_event_id") == ["e1"]
    assert ids(ask(seed, "RiskEvent", filters=f("RiskScore", "gt", 50.5)), "risk_event_id") == ["e1", "e2"], "not a whole number: dropped"
    assert ids(ask(seed, "RiskEvent", filters=f("NoSuch", "eq", "1")), "risk_event_id") == ["e1", "e2"]
    assert ids(ask(seed, "RiskEvent", aoiId="other-aoi"), "risk_event_id") == []
    assert ids(ask(seed, "RiskEvent", orderBy="distancemeters", orderDescending=True, limit=1), "risk_event_id") == ["e2"]
    assert ids(ask(seed, "RiskEvent", limit=0), "risk_event_id") == []
    near = {"operation": "within_distance", "referenceEntityType": "Asset", "distanceMeters": 200, "referenceFilters": f("AssetType", "eq", "HOSPITAL")}
    assert ids(ask(seed, "RiskEvent", spatialFilter=near), "risk_event_id") == ["e1"]
    assert ids(ask(seed, "RiskEvent", spatialFilter={**near, "referenceEntityType": "ChangePolygon"}), "risk_event_id") == ["e1", "e2"]
    assert ids(ask(seed, "RiskEvent", dateRange={"from": "2024-06-02T00:00:00Z"}), "risk_event_id") == ["e2"]
    assert ids(ask(seed, "ChangePolygon", filters=f("SlopeDegreeMean", "lt", "5")), "change_id") == ["c1"], "a missing slope counts as 0"
    assert ids(ask(seed, "ChangePolygon", filters=f("AreaSqMeters", "gt", "5,000")), "change_id") == ["c1"]
    assert ids(ask(seed, "Asset", aoiId="test-aoi", filters=f("Criticality", "gte", "high")), "asset_id") == ["hospital-1", "school-1"]
    assert ids(ask(seed, "Asset", filters=f("Name", "eq", "city")), "asset_id") == [], "names compare with case"
    assert ids(ask(seed, "ProcessingRun", filters=f("Status", "eq", "Completed")), "run_id") == ["run"]
    both = ask(seed, "RiskEvent")
    assert both.total.collect()[0].total == 2 and both.features.count() == 1, "no geometry, no feature"
    feature = json.loads(both.features.collect()[0].feature)
    assert feature["type"] == "Feature" and feature["properties"]["assetTypeName"] == "Hospital"
    assert ask(seed, "ProcessingRun").features is None
    assert {r.change_id: r.risk_event_count for r in ask(seed, "ChangePolygon").items.collect()} == {"c1": 1, "c2": 1}


def test_plan_values():
    assert [lenient_text(v) for v in ("a", 5, 2.5, True, ["x", 1, True], {"a": 1}, None)] == ["a", "5", "2.5", "true", "x,1,", "", ""]
    with pytest.raises(ValueError):
        load_plan({"targetEntity": "Planet"})


def test_split_lag_and_run_state_against_a_plain_fold(spark):
    rnd = random.Random(3)
    rows = [(f"r{rnd.randrange(3)}", T0 + dt.timedelta(hours=rnd.randrange(200)), i, rnd.choice([1, 1, 5, 6, 2]), rnd.choice(["", None, f"s{i}"])) for i in range(200)]
    df = spark.createDataFrame(rows, "run_id string, at timestamp, seq int, status int, before_scene_id string")
    got = {r.run_id: r for r in state.run_state(df, ["at", "seq"], F.date_trunc("day", c("at"))).collect()}
    for run in ("r0", "r1", "r2"):
        status, started, done, scene = 0, None, None, None
        for _, at, _, s, b in sorted((r for r in rows if r[0] == run), key=lambda r: (r[1], r[2])):
            if s != status:
                status = s
                if s == 1 and started is None:
                    started = at
                if s in (5, 6):
                    done = at
            scene = b or scene
        assert (got[run].status, got[run].started_at, got[run].completed_at, got[run].before_scene_id) == (status, started, done, scene)


def test_streamed_states_equal_the_batch_fold(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(f"r{i % 4}", T0 + dt.timedelta(hours=i), i, rnd.choice([0, 1, 3, 5, 5, 6]), rnd.choice(["", f"s{i}"])) for i in range(120)]
    schema = "run_id string, at timestamp, seq bigint, status int, before_scene_id string"
    for k in range(4):
        spark.createDataFrame(rows[k * 30:(k + 1) * 30], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    jobs.run_state_job(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {r.run_id: (r.status, r.started_at, r.completed_at, r.before_scene_id) for r in jobs.newest_state(spark.read.parquet(str(tmp_path / "out" / "state"))).collect()}
    batch = state.run_state(spark.createDataFrame(rows, schema), ["at", "seq"], F.date_trunc("day", c("at")))
    assert got == {r.run_id: (r.status, r.started_at, r.completed_at, r.before_scene_id) for r in batch.collect()} and len(got) == 4


def test_streamed_alerts_drop_repeats(spark, tmp_path):
    schema = "risk_event_id string, asset_id string, risk_score int, risk_level int, distance_meters double, created_at timestamp"
    rows = [(f"e{i}", "a", 80, i % 4, 1.0, T0) for i in range(12)]
    for part in (rows[:8], rows[4:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.alert_job(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = sorted((r.risk_event_id, r.channel) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    batch = lists.alert_rows(spark.createDataFrame(rows, schema), lists.ALERT_LEVELS)
    assert got == sorted((r.risk_event_id, r.channel) for r in batch.collect()) and len(got) == 9


def test_actions_apply_once(spark):
    ev = spark.createDataFrame([("e1", None, None, None), ("e2", T0, "old", {"k": "v"})], "risk_event_id string, acknowledged_at timestamp, acknowledged_by string, notes map<string,string>")
    log = spark.createDataFrame([("e1", T0, "ann", "hi", 1), ("e1", T0, "bob", "", 2), ("e2", T0, "cy", "x", 1), ("e9", T0, "d", "", 1)], "risk_event_id string, at timestamp, actor string, note string, seq int")
    up, bad = state.apply_once(ev, log, "acknowledged", "acknowledgmentNotes", ["at", "seq"])
    got = {r.risk_event_id: (r.acknowledged_by, r.notes) for r in up.collect()}
    assert got == {"e1": ("ann", {"acknowledgmentNotes": "hi"}), "e2": ("old", {"k": "v"})}
    assert sorted((r.risk_event_id, r.error) for r in bad.collect()) == [("e1", "already acknowledged"), ("e2", "already acknowledged"), ("e9", "not found")]


def test_metadata_overlay(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3"}), (None, {"x": "1"}), ({"a": "1"}, None)], "o map<string,string>, n map<string,string>")
    assert [r[0] for r in df.select(state.overlay(c("o"), c("n"))).collect()] == [{"a": "1", "b": "3"}, {"x": "1"}, {"a": "1"}]


def test_area_and_run_loads(spark):
    have = spark.createDataFrame([("a1",)], "aoi_id string")
    batch = spark.createDataFrame([(1, "a1", [1.0] * 4), (2, "a2", [1.0] * 4), (3, "a2", [1.0] * 4), (4, "a3", [1.0] * 3)], "seq int, aoi_id string, bounding_box array<double>")
    good, bad = loads.load_areas(batch, have, "seq")
    assert [r.seq for r in good.collect()] == [2]
    assert {r.seq: r.error for r in bad.collect()} == {1: "Area of Interest already exists", 3: "Area of Interest already exists", 4: "BoundingBox must have 4 values"}
    good, bad = loads.load_runs(spark.createDataFrame([("r1", "a1"), ("r2", "zz")], "run_id string, aoi_id string"), have)
    assert [(r.run_id, r.status) for r in good.collect()] == [("r1", 0)] and loads.error_sample(bad, "run_id", 100).count() == 1


def test_check_prefers_the_newest_unused_scene(spark):
    areas = spark.createDataFrame([("a", 90, 20.0), ("b", 30, 20.0)], "aoi_id string, default_lookback_days int, max_cloud_cover double")
    runs = spark.createDataFrame([("r", "a", RUN_STATUSES["Completed"], dt.datetime(2024, 6, 15), "S0", "S2", T0)],
                                 "run_id string, aoi_id string, status int, after_date timestamp, before_scene_id string, after_scene_id string, created_at timestamp")
    day = lambda d: dt.datetime(2024, 6, d, 10)
    scenes = spark.createDataFrame([("a", "S1", day(17), 5.0), ("a", "S2", day(18), 5.0), ("a", "S3", day(19), 25.0), ("a", "S4", day(15), 1.0), ("b", "S5", day(10), 3.0)],
                                   "aoi_id string, scene_id string, acquired_at timestamp, cloud_cover double")
    now = F.lit("2024-06-20 00:00:00").cast("timestamp")
    got = {r.aoi_id: r for r in checks.check_areas(areas, runs, scenes, now).collect()}
    assert (got["a"].scene_id, got["a"].since_date, got["a"].recommended_before_date, got["a"].recommended_after_date) == ("S1", "2024-06-16", "2024-06-15", "2024-06-17")
    assert (got["b"].scene_id, got["b"].since_date, got["b"].recommended_before_date) == ("S5", "2024-05-21", "2024-05-11")
    busy = runs.withColumn("status", F.lit(2))
    made, marked = checks.scheduled_check(areas, runs.unionByName(busy), scenes, now)
    assert [r.aoi_id for r in made.collect()] == ["b"] and marked.where("last_checked_at IS NOT NULL").count() == 2


def test_unlimited_collection_is_no_single_row(spark):
    rows = [(f"asset-{k}", f"aoi-{k % 2}", "na\nme", 6, 3, "d", -121.5, 39.7) for k in range(30)]
    df = spark.createDataFrame(rows, "asset_id string, aoi_id string, name string, asset_type int, criticality int, source_dataset string, lon double, lat double")
    got = ingest.asset_collection(SimpleNamespace(assets=df))
    assert "collect_list" not in got._jdf.queryExecution().toString()
    assert [tuple(r) for r in got.collect()] == [(15, "asset-1")]
    assert [tuple(r) for r in ingest.asset_collection(SimpleNamespace(assets=df.limit(0))).collect()] == [(0, None)]


def test_geometry_checks_read_each_place(spark):
    rows = [(f"asset-{k}", 2, lon, 39.7) for k, lon in ((0, -121.5), (1, -121.5), (2, -121.5), (5, 179.9995), (8, -180.5))]
    df = spark.createDataFrame(rows, "asset_id string, criticality int, lon double, lat double")
    bad, far = "Invalid GeoJSON geometry", "Coordinates outside WGS84 range"
    got = {r.asset_id: r.error for r in ingest.geometry_checks(SimpleNamespace(assets=df)).collect()}
    assert got == {"asset-0": bad, "asset-1": far, "asset-2": None, "asset-5": far, "asset-8": far}


def test_catalog_and_collections_from_files(spark, tmp_path):
    item = {"id": "S1", "bbox": [1, 2, 3, 4], "properties": {"datetime": "2024-06-01T10:00:00Z", "platform": "p", "proj:epsg": 32610},
            "assets": {"B04": {"href": "h4", "type": "t"}, "preview": {"href": "x", "type": "t"}}}
    (tmp_path / "items.json").write_text(json.dumps({"features": [item, {"id": "S2", "properties": {}}]}, indent=1))
    got = {r.scene_id: r for r in S.read_items(spark, str(tmp_path / "items.json")).collect()}
    assert list(got["S1"].bands) == ["B04"] and got["S1"].cloud_cover == 0.0 and got["S1"].epsg == 32610
    assert got["S2"].min_lon == 0.0 and got["S2"].acquired_at is not None and got["S2"].bands == {}
    feats = {"type": "FeatureCollection", "features": [{"type": "Feature", "id": "f1", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"power": "line", "n": 5}},
                                                       {"type": "Feature", "geometry": None, "properties": {}}]}
    (tmp_path / "f.geojson").write_text(json.dumps(feats))
    rows = J.read_collection(spark, str(tmp_path / "f.geojson")).orderBy("seq").collect()
    assert [(r.feature_id, r.geometry and r.geometry.type) for r in rows] == [("f1", "Point"), ("1", None)] and rows[0].properties["n"] == "5"
    assert J.read_collection(spark, str(tmp_path / "missing.geojson")).count() == 0


def test_object_listing_and_metadata(spark, tmp_path):
    for p in ("aoi/sc1/B04.tif", "aoi/sc1/rgb.png", "aoi/sc2/x.TIF"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"12345")
    objects = L.list_files(spark, str(tmp_path))
    assert {r.scene_id: (r.file_count, r.size_bytes) for r in L.scene_list(objects).collect()} == {"sc1": (1, 5), "sc2": (1, 5)}
    text = '{"source_id":"polygon-1","point_count":10,"point_density_per_m2":0.5,"crs_epsg":32610,"resolution_m":1.0,"bounds":[1,2,3,4],"classification_counts":{"2":7,"5":3}}'
    m = L.terrain_metadata(spark.createDataFrame([("aoi/polygon-1/metadata.json", text)], "path string, text string")).collect()[0]
    assert m.classification_counts == {2: 7, 5: 3} and m.bounds == [1.0, 2.0, 3.0, 4.0]
    L.write_artifacts(spark.createDataFrame([("a", "s", 1)], "aoi_id string, scene_id string, v int"), str(tmp_path / "out"), "aoi_id", "scene_id")
    assert (tmp_path / "out" / "aoi_id=a" / "scene_id=s").exists()


def test_ways_of_any_length_are_features(spark):
    wn = spark.createDataFrame([(1, k, k) for k in range(5)] + [(2, 0, 0), (2, 1, 1), (2, 0, 2)] + [(3, 0, 0), (3, 99, 1)], "way_id int, node_id int, pos int")
    nodes = spark.createDataFrame([(k, float(k), 0.0) for k in range(5)], "node_id int, lon double, lat double")
    got = A.way_features(wn, nodes, "building").collect()
    assert sorted((r.feature_id, r.geometry_type, r.vertex_count) for r in got) == [("way/1", "LineString", 5), ("way/2", "LineString", 3)], "closed but only three vertices"


def test_declared_rows_and_views(spark, seed):
    assert len(DETECTED_ROWS) == 12 and spark.createDataFrame([], DETECTED_ROWS).columns[0] == "geometry"
    assert "scoring_factors" in EVENT_ROWS.names
    areas = spark.createDataFrame([("test-aoi", "T")], "aoi_id string, name string")
    names = views.register_views({"areas": areas, "assets": seed["assets"], "changes": seed["changes"], "risk_events": seed["risk_events"]}, "tv_")
    assert len(names) == 6 and spark.table("tv_assets_points").count() == 3 and spark.table("tv_risk_events").count() == 2
