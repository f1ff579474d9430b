"""Stored rasters and artifacts read back, single creates, lookups by key, views and ground areas."""

import uuid

from pyspark.sql import functions as F

from landwatch.catalogue.lists import V
from landwatch.catalogue.rasters import DIFF, diff
from landwatch.catalogue.registry import query
from landwatch.functions import geometry as G
from landwatch.operators import loads
from landwatch.operators import raster as R
from landwatch.operators import regions as C
from landwatch.schema import CHANGE_TYPES, DETECTED_ROWS
from landwatch.session import shared_dir
from landwatch.sources import listing, views

c = F.col


def place(t):
    return f"{shared_dir(t.spark)}/stored-{uuid.uuid4().hex}"


@query("pixels", f"""WITH {DIFF} SELECT concat('run-', row_idx % 3) AS run_id, count(*) AS pixels, CAST(sum(m) AS BIGINT) AS changed, round(sum(d::DOUBLE), 5) AS diff_sum FROM df GROUP BY 1""")
def stored_change_rasters(t):
    """Difference and mask rasters written per run and read back by folder."""
    path = place(t)
    R.write_change_rasters(diff(t).withColumn("run_id", F.concat(F.lit("run-"), c("row_idx") % 3)), path, ["run_id"])
    back = t.spark.read.parquet(path)
    return back.groupBy("run_id").agg(F.count("*").alias("pixels"), F.sum(c("changed").cast("bigint")).alias("changed"),
                                      F.round(F.sum(c("ndvi_diff").cast("double")), 5).alias("diff_sum"))


@query("objects", """SELECT split_part(path, '/', 1) AS aoi_id, split_part(path, '/', 2) AS scene_id, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM objects GROUP BY 1, 2""")
def stored_artifacts(t):
    """Artifacts under area and scene folders, read back by folder."""
    path, part = place(t), F.split("path", "/")
    listing.write_artifacts(t.objects.withColumns({"aoi_id": part[0], "scene_id": part[1]}), path, "aoi_id", "scene_id")
    return t.spark.read.parquet(path).groupBy("aoi_id", "scene_id").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


@query("stored_changes", """SELECT change_type, count(*) AS changes, round(sum(area_sq_meters), 3) AS area, count(slope_degree_mean) AS with_slope FROM (
SELECT CASE change_type WHEN 6 THEN 'LandslideDebris' WHEN 1 THEN 'VegetationLoss' WHEN 2 THEN 'VegetationGain' ELSE 'Unknown' END AS change_type, area_sq_meters, slope_degree_mean FROM stored_changes) GROUP BY 1""")
def detected_change_rows(t):
    """Changes in the declared columns of a detection, written and read back under that schema."""
    from landwatch.schema import name_of
    h, path = c("half_size_deg"), place(t)
    have = {"geometry": G.box(c("lon") - h, c("lat") - h, c("lon") + h, c("lat") + h), "change_type": name_of(CHANGE_TYPES, c("change_type"))}
    known = t.stored_changes.withColumns(have)
    rows = known.select(*[(c(f.name) if f.name in known.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in DETECTED_ROWS])
    rows.write.parquet(path)
    back = t.spark.read.schema(DETECTED_ROWS).parquet(path)
    return back.groupBy("change_type").agg(F.count("*").alias("changes"), F.round(F.sum("area_sq_meters"), 3).alias("area"), F.count("slope_degree_mean").alias("with_slope"))


@query("changes", """SELECT change_id, true AS close_to_plane FROM changes""")
def ground_areas(t):
    """Areas of degree boxes measured in their UTM zone, within half a percent of the box on the sphere of that latitude."""
    h = c("half_size_deg")
    d = C.ground_area(t.changes.withColumn("geometry", G.box(c("lon") - h, c("lat") - h, c("lon") + h, c("lat") + h)), "measured")
    lat = F.radians("lat")
    # metres a degree on the ellipsoid, fixed series
    tall = 111132.954 - 559.822 * F.cos(2 * lat) + 1.175 * F.cos(4 * lat)
    wide = 111412.84 * F.cos(lat) - 93.5 * F.cos(3 * lat) + 0.118 * F.cos(5 * lat)
    flat = 4 * h * h * tall * wide
    return d.select("change_id", (F.abs(c("measured") / flat - 1) < 0.005).alias("close_to_plane"))


@query("", """WITH b AS (SELECT c_custkey AS seq, concat('new-', c_custkey % 700) AS aoi_id, CASE WHEN c_custkey % 9 = 0 THEN 3 ELSE 4 END AS n FROM customer
UNION ALL SELECT r_regionkey, concat('aoi-', r_regionkey), 4 FROM region), f AS (SELECT *, min(seq) OVER (PARTITION BY aoi_id) AS first FROM b)
SELECT CASE WHEN aoi_id LIKE 'aoi-%' OR seq > first THEN 'Area of Interest already exists' WHEN n <> 4 THEN 'BoundingBox must have 4 values' END AS error, count(*) AS rows FROM f GROUP BY 1""")
def area_load_outcome(t):
    """Creates of areas: used ids and boxes without four numbers are refused."""
    k, four = c("c_custkey"), F.array(*[F.lit(float(v)) for v in range(4)])
    new = t.customer.select(k.alias("seq"), F.concat(F.lit("new-"), k % 700).alias("aoi_id"), F.when(k % 9 == 0, F.slice(four, 1, 3)).otherwise(four).alias("bounding_box"))
    old = t.aois.select(F.regexp_extract("aoi_id", r"(\d+)", 1).cast("long").alias("seq"), "aoi_id", four.alias("bounding_box"))
    return loads.outcome(*loads.load_areas(new.unionByName(old), t.aois, "seq"))


@query("", """SELECT CASE WHEN o_orderkey % 7 >= 5 THEN 'Area of Interest not found' END AS error, count(*) AS rows FROM orders GROUP BY 1""")
def run_load_outcome(t):
    """Creates of runs: unknown areas are refused, the others wait."""
    rows = t.orders.select(c("o_orderkey").alias("run_id"), F.concat(F.lit("aoi-"), c("o_orderkey") % 7).alias("aoi_id"))
    good, bad = loads.load_runs(rows, t.aois)
    return loads.outcome(good.where("status = 0"), bad)


@query("assets " + V, """SELECT asset_id, aoi_id, name, asset_type, criticality, source_dataset, lon, lat FROM assets WHERE asset_id = 'asset-77'""")
def asset_by_id(t):
    return t.assets.where(c("asset_id") == "asset-77").select("asset_id", "aoi_id", "name", "asset_type", "criticality", "source_dataset", "lon", "lat")


@query(V, """SELECT r.run_id, r.aoi_id, r.status, r.before_date, r.after_date, (SELECT count(*) FROM stored_changes c WHERE c.run_id = 'run-1-1') AS change_count,
(SELECT count(*) FROM stored_events e JOIN stored_changes c USING (change_id) WHERE c.run_id = 'run-1-1') AS event_count FROM stored_runs r WHERE r.run_id = 'run-1-1'""")
def run_by_id(t):
    """One run with its changes and events counted."""
    from landwatch.operators import lists as L
    same = c("run_id") == "run-1-1"
    return L.run_counts(t.stored_runs.where(same), t.stored_changes.where(same), t.stored_events).select(
        "run_id", "aoi_id", "status", "before_date", "after_date", "change_count", "event_count")


@query("assets " + V, """WITH one AS (SELECT min(risk_event_id) AS id FROM stored_events) SELECT e.risk_event_id, e.risk_score, e.risk_level, e.distance_meters, c.change_id, c.run_id, c.area_sq_meters, a.name AS asset_name, a.criticality
FROM stored_events e LEFT JOIN stored_changes c ON e.change_id = c.change_id LEFT JOIN assets a ON e.asset_id = a.asset_id WHERE e.risk_event_id = (SELECT id FROM one)""")
def event_by_id(t):
    """One risk event with its change and asset in full."""
    first = t.stored_events.agg(F.min("risk_event_id")).first()[0]
    e = t.stored_events.where(c("risk_event_id") == first)
    ch = t.stored_changes.select("change_id", "run_id", "area_sq_meters")
    a = t.assets.select("asset_id", c("name").alias("asset_name"), "criticality")
    return e.join(ch, "change_id", "left").join(a, "asset_id", "left").select(
        "risk_event_id", "risk_score", "risk_level", "distance_meters", "change_id", "run_id", "area_sq_meters", "asset_name", "criticality")


@query("aois assets " + V, """SELECT 'assets_points' AS view_name, (SELECT count(*) FROM assets WHERE CAST(regexp_extract(asset_id, '\\d+') AS BIGINT) % 3 = 0) AS rows
UNION ALL SELECT 'assets_lines', (SELECT count(*) FROM assets WHERE CAST(regexp_extract(asset_id, '\\d+') AS BIGINT) % 3 = 1)
UNION ALL SELECT 'assets_polygons', (SELECT count(*) FROM assets WHERE CAST(regexp_extract(asset_id, '\\d+') AS BIGINT) % 3 = 2)
UNION ALL SELECT 'areas_of_interest', (SELECT count(*) FROM aois) UNION ALL SELECT 'change_polygons', (SELECT count(*) FROM stored_changes)
UNION ALL SELECT 'risk_events', (SELECT count(*) FROM stored_events JOIN stored_changes USING (change_id))""")
def reporting_views(t):
    """Rows behind each of the six views, assets of three geometry kinds."""
    k, x, y, h = F.regexp_extract("asset_id", r"(\d+)", 1).cast("long") % 3, c("lon"), c("lat"), c("half_size_deg")
    geom = F.when(k == 0, G.point(x, y)).when(k == 1, G.line(F.array(G.vertex(x, y), G.vertex(x + 0.01, y)))).otherwise(G.box(x, y, x + 0.01, y + 0.01))
    ch = t.stored_changes.withColumn("geometry", G.box(x - h, y - h, x + h, y + h))
    prefix = f"v{uuid.uuid4().hex}_"
    names = views.register_views({"areas": t.aois, "assets": t.assets.withColumn("geometry", geom), "changes": ch, "risk_events": t.stored_events}, prefix)
    out = None
    for name in names:
        one = t.spark.table(name).agg(F.count("*").alias("rows")).select(F.lit(name.removeprefix(prefix)).alias("view_name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


@query("", """SELECT concat('aoi-', o_orderkey % 5) AS aoi_id, o_orderkey AS point_count, o_orderkey % 9 + 1 AS ground, round(o_totalprice / 7, 2) AS density FROM orders""")
def terrain_metadata(t):
    """Product metadata parsed from texts made of the orders."""
    k = c("o_orderkey")
    text = F.to_json(F.struct(F.concat(F.lit("polygon-"), k).alias("source_id"), k.alias("point_count"), F.round(c("o_totalprice") / 7, 2).alias("point_density_per_m2"),
                              F.lit(32610).alias("crs_epsg"), F.lit(1.0).alias("resolution_m"), F.array(F.lit(1.0)).alias("bounds"),
                              F.create_map(F.lit("2"), k % 9 + 1).alias("classification_counts")))
    path = F.concat(F.lit("aoi-"), k % 5, F.lit("/polygon-"), k, F.lit("/metadata.json"))
    m = listing.terrain_metadata(t.orders.select(path.alias("path"), text.alias("text")))
    return m.select("aoi_id", "point_count", c("classification_counts")[2].alias("ground"), c("point_density_per_m2").alias("density"))
