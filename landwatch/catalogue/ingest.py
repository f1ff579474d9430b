"""Raw features to assets, feature collections, object listings and reviewer texts."""

import math
import uuid

from pyspark.sql import functions as F

from landwatch.catalogue.registry import query
from landwatch.catalogue.scoring import asset_points, event_pairs, typed_changes
from landwatch.catalogue.sqltext import EVENT_PAIRS, SCORE
from landwatch.functions import geometry as G
from landwatch.functions import narrative as N
from landwatch.functions import projection as P
from landwatch.operators import scoring as S
from landwatch.operators.loads import make_asset_id
from landwatch.session import shared_dir
from landwatch.sources import assets as A
from landwatch.sources import geojson as J
from landwatch.sources import listing as L

c = F.col


def properties():
    tag = {"name": "feature_name", "NAME": "upper_name", "building": "building", "highway": "highway", "power": "power", "VOLTAGE": "voltage",
           "OWNER": "owner", "operator": "owner", "typepipe": "typepipe", "addr:street": "street", "addr:housenumber": "housenumber"}
    pairs = [v for k, col in tag.items() for v in (F.lit(k), c(col).cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())


def raw_features(t):
    """Features as JSON texts, read back by the feature reader."""
    geom = F.to_json(F.struct(F.lit("Point").alias("type"), F.array(F.lit(-121.6), F.lit(39.75)).alias("coordinates")))
    text = F.concat(F.lit('{"type":"Feature","geometry":'), geom, F.lit(',"properties":'), F.to_json(properties()), F.lit("}"))
    return J.parse_features(t.raw_features.select("seq", "source", text.alias("text")), "text", "seq")


KIND = """CASE source WHEN 'osm_buildings' THEN 3 WHEN 'osm_roads' THEN 4 WHEN 'cec_transmission' THEN 0 WHEN 'cec_substations' THEN 1 WHEN 'eia_pipelines' THEN 2
 WHEN 'hifld_fire_stations' THEN 5 WHEN 'hifld_hospitals' THEN 6 WHEN 'hifld_schools' THEN 7 WHEN 'osm_power' THEN CASE WHEN power IN ('line', 'minor_line', 'tower', 'pole') THEN 0 ELSE 99 END ELSE 99 END"""
RANK = """CASE source WHEN 'osm_buildings' THEN CASE WHEN building = 'hospital' THEN 3 WHEN building IN ('school', 'college') THEN 2 WHEN building = 'retail' THEN 1 ELSE 0 END
 WHEN 'osm_roads' THEN CASE WHEN highway IN ('motorway', 'primary') THEN 3 WHEN highway = 'tertiary' THEN 2 WHEN highway = 'service' THEN 1 ELSE 0 END
 WHEN 'osm_power' THEN CASE WHEN power = 'line' THEN 3 WHEN power = 'minor_line' THEN 2 WHEN power IN ('tower', 'pole') THEN 1 ELSE 0 END
 WHEN 'cec_transmission' THEN CASE WHEN voltage >= 230 THEN 3 WHEN voltage >= 115 THEN 2 ELSE 1 END WHEN 'other' THEN 0 WHEN 'hifld_schools' THEN 2 ELSE 3 END"""


@query("raw_features", f"SELECT seq, source, {KIND} AS asset_type, {RANK} AS criticality FROM raw_features")
def asset_kinds(t):
    """Asset type and criticality of raw features by source and tag."""
    return raw_features(t).select("seq", "source", *[v.alias(k) for k, v in A.asset_kind(c("source"), c("properties")).items()])


@query("raw_features", """SELECT seq, coalesce(nullif(feature_name, ''), upper_name, CASE source
WHEN 'osm_buildings' THEN coalesce(CASE WHEN housenumber IS NOT NULL THEN concat(housenumber, ' ', nullif(street, '')) END, street, concat('Building ', seq + 1))
WHEN 'osm_roads' THEN coalesce(feature_name, concat('Road ', seq + 1)) WHEN 'osm_power' THEN concat(CASE WHEN power IN ('line', 'minor_line') THEN 'Power Line ' WHEN power = 'tower' THEN 'Power Tower '
 WHEN power = 'pole' THEN 'Power Pole ' ELSE 'Power Feature ' END, seq + 1)
WHEN 'cec_transmission' THEN CASE WHEN owner IS NOT NULL AND voltage IS NOT NULL THEN concat(owner, ' ', voltage, 'kV Line') ELSE concat('Transmission Line ', seq + 1) END
WHEN 'cec_substations' THEN concat('Substation ', seq + 1) WHEN 'eia_pipelines' THEN CASE WHEN owner IS NOT NULL AND typepipe IS NOT NULL THEN concat(owner, ' - ', typepipe)
 WHEN owner IS NOT NULL THEN concat(owner, ' Pipeline') ELSE concat('Gas Pipeline ', seq + 1) END
WHEN 'hifld_fire_stations' THEN concat('Fire Station ', seq + 1) WHEN 'hifld_hospitals' THEN concat('Hospital ', seq + 1) WHEN 'hifld_schools' THEN concat('School ', seq + 1)
ELSE concat('Feature ', seq + 1) END) AS name FROM (SELECT * REPLACE (CASE WHEN source = 'osm_buildings' AND housenumber IS NOT NULL AND street IS NULL THEN NULL ELSE housenumber END AS housenumber) FROM raw_features)""")
def asset_names(t):
    """Names of raw features from tags, addresses, owners or a running number."""
    f = raw_features(t)
    return f.select("seq", A.feature_name(c("source"), c("properties"), c("seq")).alias("name"))


@query("raw_features", f"""SELECT source_dataset, asset_type, count(*) AS assets FROM (SELECT replace(source, '_', '-') AS source_dataset, {KIND} AS asset_type FROM raw_features WHERE source <> 'other') GROUP BY ALL""")
def assets_from_sources(t):
    """Assets of the nine sources, each read on its own and united."""
    f = raw_features(t)
    names = ["osm_buildings", "osm_roads", "osm_power", *["cec_transmission"], *A.SINGLE_KIND]
    united = A.union_sources({n: f.where(c("source") == n).drop("source") for n in names})
    return A.typed_assets(united, "aoi-0", "seq").groupBy("source_dataset", "asset_type").agg(F.count("*").alias("assets"))


@query("raw_features", """SELECT coalesce(source, 'total') AS source, count(*) FILTER (voltage IS NOT NULL) AS success, count(*) FILTER (voltage IS NULL) AS failure FROM raw_features GROUP BY ROLLUP (source)""")
def ingest_tally(t):
    """Accepted and rejected features per source and in total."""
    return A.ingest_tally(t.raw_features.withColumn("accepted", c("voltage").isNotNull()))


@query("assets", """SELECT asset_id, concat(aoi_id, '-', sha256(concat_ws('|', name, source_dataset))) AS generated_id FROM assets""")
def generated_asset_ids(t):
    return t.assets.select("asset_id", make_asset_id(c("aoi_id"), c("name"), c("source_dataset")).alias("generated_id"))


def mixed_features(t):
    """Assets in four datasets, two of them in Web Mercator; every 40th geometry is broken."""
    k = F.regexp_extract("asset_id", r"(\d+)", 1).cast("long")
    a = t.assets.withColumns({"seq": k, "dataset": k % 4})
    merc = c("dataset") % 2 == 1
    x, y = F.when(merc, P.mercator_x(c("lon"))).otherwise(c("lon")), F.when(merc, P.mercator_y(c("lat"))).otherwise(c("lat"))
    return a.select("asset_id", "dataset", "seq", F.when(~((k % 40 == 39)), G.point(x, y)).alias("geometry"))


BOX = (-121.68003, 39.71003, -121.45003, 39.75003)


@query("assets", f"""SELECT asset_id, CAST(regexp_extract(asset_id, '\\d+') AS BIGINT) % 4 AS dataset, round(lon, 7) AS lon, round(lat, 7) AS lat FROM assets WHERE lon BETWEEN {BOX[0]} AND {BOX[2]}
AND lat BETWEEN {BOX[1]} AND {BOX[3]} AND CAST(regexp_extract(asset_id, '\\d+') AS BIGINT) % 40 <> 39""")
def features_in_box(t):
    """Features of mixed coordinate systems inside a box, all in degrees afterwards."""
    f = J.filter_to_box(mixed_features(t), "dataset", "seq", BOX)
    v = F.get(G.vertices(c("geometry")), F.lit(0))
    return f.select("asset_id", "dataset", F.round(v["x"], 7).alias("lon"), F.round(v["y"], 7).alias("lat"))


@query("assets", f"""SELECT count(*) AS features FROM assets WHERE lon BETWEEN -121.50003 - 0.05 AND -121.45003 + 0.05 AND lat BETWEEN 39.73003 - 0.05 AND 39.75003 + 0.05 AND CAST(regexp_extract(asset_id, '\\d+') AS BIGINT) % 40 <> 39""")
def features_in_padded_box(t):
    """The same with the box widened for long features."""
    return J.filter_to_box(mixed_features(t), "dataset", "seq", (-121.50003, 39.73003, -121.45003, 39.75003), 0.05).agg(F.count("*").alias("features"))


@query("way_nodes nodes", """WITH v AS (SELECT w.way_id, w.pos, n.lon, n.lat FROM way_nodes w JOIN nodes n ON w.node_id = n.node_id),
s AS (SELECT way_id, count(*) AS vertex_count, arg_min((lon, lat), pos) AS a, arg_max((lon, lat), pos) AS b, arg_min(lon, pos) AS first_x, arg_max(lat, pos) AS last_y FROM v GROUP BY way_id)
SELECT concat('way/', way_id) AS feature_id, CASE WHEN a = b AND vertex_count >= 4 THEN 'Polygon' ELSE 'LineString' END AS geometry_type, vertex_count, first_x, last_y, way_id::VARCHAR AS osm_id FROM s WHERE vertex_count >= 2""")
def way_features(t):
    """Lines and closed areas built from ordered way nodes; unknown nodes drop out."""
    f = A.way_features(t.way_nodes, t.nodes, "building")
    v = G.vertices(c("geometry"))
    return f.select("feature_id", "geometry_type", F.size(v).cast("long").alias("vertex_count"), F.get(v, F.lit(0))["x"].alias("first_x"),
                    F.element_at(v, -1)["y"].alias("last_y"), c("properties")["osm_id"].alias("osm_id"))


@query("way_nodes nodes", """SELECT way_id, pos, n.lon AS x, n.lat AS y FROM way_nodes w JOIN nodes n ON w.node_id = n.node_id""")
def way_vertices(t):
    """Every known node of every way in long form."""
    return A.way_vertices(t.way_nodes, t.nodes)


@query("nodes", """SELECT concat('node/', node_id) AS feature_id, lon, lat, tag AS kind FROM nodes WHERE tag <> 'ECONOMY'""")
def node_features(t):
    n = t.nodes.withColumn("tags", F.when(c("tag") != "ECONOMY", F.create_map(F.lit("kind"), c("tag"))))
    f = A.node_features(n)
    v = F.get(G.vertices(c("geometry")), F.lit(0))
    return f.select("feature_id", v["x"].alias("lon"), v["y"].alias("lat"), c("properties")["kind"].alias("kind"))


# --- feature collections ----------------------------------------------------------

@query("assets", """SELECT asset_id, CASE WHEN k % 3 = 0 THEN 'Invalid GeoJSON geometry' WHEN k % 3 = 1 THEN 'Coordinates outside WGS84 range' END AS error FROM (SELECT asset_id, CAST(regexp_extract(asset_id, '\\d+') AS BIGINT) AS k FROM assets)""")
def geometry_checks(t):
    """GeoJSON geometries at each asset's place, some spoiled, parsed and checked against degree limits."""
    k, far = F.regexp_extract("asset_id", r"(\d+)", 1).cast("long"), 0.001 * (1 + c("criticality"))
    at = lambda dx=0, dy=0: F.array(c("lon") + dx, c("lat") + dy)
    ring = lambda d: F.array(F.array(at(d, d), at(d + far, d), at(d + far, d + far), at(d, d)))
    shaped = lambda kind, places: F.to_json(F.struct(F.lit(kind).alias("type"), places.alias("coordinates")))
    text = (F.when(k % 3 == 0, shaped("Point", F.concat_ws(",", at().cast("array<string>")))).when(k % 3 == 1, shaped("LineString", F.array(at(), at(360))))
            .otherwise(shaped("MultiPolygon", F.array(ring(F.lit(0.0)), ring(2 * far)))))
    good, bad = J.check_geometry(t.assets.select("asset_id", G.from_geojson(text).alias("geometry")))
    return good.select("asset_id", F.lit(None).cast("string").alias("error")).unionByName(bad.select("asset_id", "error"))


@query("assets", """SELECT asset_id, concat('{"type":"Feature","id":"', asset_id, '","geometry":{"type":"Point","coordinates":[', lon, ',', lat, ']},"properties":{"name":"', name, '","assetType":', asset_type,
',"assetTypeName":"', CASE asset_type WHEN 3 THEN 'Building' WHEN 6 THEN 'Hospital' ELSE 'School' END, '","criticality":', criticality, ',"criticalityName":"', CASE criticality WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' ELSE 'Critical' END,
'","sourceDataset":"', source_dataset, '"}}') AS feature FROM assets WHERE aoi_id = 'aoi-2' AND asset_type IN (3, 6, 7)""")
def asset_feature_export(t):
    """Feature texts of an area's assets of three types."""
    return J.asset_features(t.assets.withColumn("geometry", G.point(c("lon"), c("lat"))), "aoi-2", "3, 6,7")


@query("assets", """SELECT count(*) AS features, min(asset_id) AS first_id FROM assets WHERE aoi_id = 'aoi-1'""")
def asset_collection(t):
    """All features of an area, written one per line in parallel files and read back."""
    spark = t.assets.sparkSession
    path = f"{shared_dir(spark)}/asset-collection-{uuid.uuid4().hex}"
    J.write_features(J.asset_features(t.assets.withColumn("geometry", G.point(c("lon"), c("lat"))), "aoi-1"), path)
    return spark.read.text(path).select(F.get_json_object("value", "$.id").alias("id")).agg(F.count("*").alias("features"), F.min("id").alias("first_id"))


@query("assets", "SELECT asset_id, name, asset_type::VARCHAR AS asset_type, round(lon, 9) AS lon, round(lat, 9) AS lat FROM assets WHERE aoi_id = 'aoi-2'")
def asset_collection_files(t):
    """Assets of an area as collection files, each of them read back in blocks."""
    spark = t.assets.sparkSession
    path = f"{shared_dir(spark)}/asset-files-{uuid.uuid4().hex}"
    J.write_collections(J.asset_features(t.assets.withColumn("geometry", G.point(c("lon"), c("lat"))), "aoi-2"), path)
    got, spot = J.read_collection(spark, path), G.centroid(c("geometry"))
    return got.select(c("feature_id").alias("asset_id"), c("properties")["name"].alias("name"), c("properties")["assetType"].alias("asset_type"),
                      F.round(spot["x"], 9).alias("lon"), F.round(spot["y"], 9).alias("lat"))


@query("stored_changes stored_runs", """SELECT ch.change_id, 'Polygon' AS kind, ch.area_sq_meters, CASE change_type WHEN 0 THEN 'Unknown' WHEN 1 THEN 'VegetationLoss' WHEN 2 THEN 'VegetationGain' ELSE 'LandslideDebris' END AS change_type_name
FROM stored_changes ch JOIN stored_runs r ON ch.run_id = r.run_id WHERE r.aoi_id = 'aoi-3'""")
def change_feature_export(t):
    """Feature texts of an area's changes, read back."""
    h = c("half_size_deg")
    ch = t.stored_changes.withColumn("geometry", G.box(c("lon") - h, c("lat") - h, c("lon") + h, c("lat") + h))
    f, g = J.change_features(ch, t.stored_runs, aoi_id="aoi-3"), lambda p: F.get_json_object("feature", p)
    return f.select("change_id", g("$.geometry.type").alias("kind"), g("$.properties.areaSqMeters").cast("double").alias("area_sq_meters"),
                    g("$.properties.changeTypeName").alias("change_type_name"))


@query("changes", """SELECT change_id, area_sq_meters, CASE WHEN is_landslide THEN 6 WHEN ndvi_drop_mean < -0.4::DOUBLE THEN CASE WHEN land_cover_class = 'Forest' THEN 3 WHEN land_cover_class IN ('AnnualCrop', 'PermanentCrop') THEN 5 ELSE 1 END
WHEN ndvi_drop_mean < -0.2::DOUBLE THEN CASE WHEN land_cover_class IN ('AnnualCrop', 'PermanentCrop') THEN 5 WHEN land_cover_class IN ('HerbaceousVegetation', 'Pasture') THEN 4 ELSE 1 END
WHEN ndvi_drop_mean > 0.2::DOUBLE THEN 2 ELSE 0 END AS change_code FROM changes""")
def change_submission(t):
    """Detected changes as submission records with type codes."""
    null = F.lit(None).cast("double")
    ch = typed_changes(t).withColumns({"ndvi_drop_max": c("ndvi_drop_mean"), "slope_degree_max": null, "ml_confidence": null, "ml_model_version": c("change_id")})
    return J.submission(ch).select(c("mlModelVersion").alias("change_id"), c("areaSqMeters").alias("area_sq_meters"), c("changeType").alias("change_code"))


# --- listings -----------------------------------------------------------------------

PLACED = """pl AS (SELECT *, split_part(path, '/', 1) AS aoi_id, split_part(path, '/', 2) AS scene_id, split_part(path, '/', 3) AS file_name FROM objects)"""


@query("objects", f"WITH {PLACED} SELECT aoi_id, scene_id, count(*) AS file_count, CAST(sum(size_bytes) AS BIGINT) AS size_bytes, max(modified_at) AS modified_at FROM pl WHERE file_name LIKE '%.tif' GROUP BY ALL")
def scene_list(t):
    """Scenes found in an object listing."""
    return L.scene_list(t.objects)


@query("objects", f"WITH {PLACED} SELECT aoi_id, scene_id, file_name, size_bytes, modified_at FROM pl WHERE file_name LIKE '%.tif'")
def scene_files(t):
    return L.scene_files(t.objects).select("aoi_id", "scene_id", "file_name", "size_bytes", "modified_at")


@query("objects aois", f"""WITH {PLACED}, im AS (SELECT * FROM pl WHERE file_name LIKE '%.tif' OR file_name LIKE '%.png'),
s AS (SELECT aoi_id, scene_id, count(*) AS file_count, min(path) FILTER (file_name LIKE '%.png') AS png, min(path) AS any_path FROM im GROUP BY ALL)
SELECT s.aoi_id, s.scene_id, file_count, coalesce(png, any_path) AS display_path, CASE WHEN scene_id LIKE '%5' THEN -120.5::DOUBLE ELSE a.min_lon END AS min_lon FROM s JOIN aois a ON s.aoi_id = a.aoi_id""")
def scene_details(t):
    """Scenes with bounds from a sidecar or the area, and the picture to show."""
    side = L.located(t.objects).where(c("scene_id").endswith("5")).select("aoi_id", "scene_id").distinct().select(
        F.concat_ws("/", "aoi_id", "scene_id", F.lit("rgb.bounds.json")).alias("path"), F.lit('{"bounds":[-120.5,39.0,-120.0,39.5]}').alias("text"))
    return L.scene_details(t.objects, t.aois, side).select("aoi_id", "scene_id", "file_count", "display_path", F.get("bounds", F.lit(0)).alias("min_lon"))


@query("objects", """WITH o AS (SELECT DISTINCT concat('aoi-', user_id % 5) AS aoi_id, concat('polygon-', event_id % 200) AS source_id, CASE event_id % 5 WHEN 0 THEN 'dtm.tif' WHEN 1 THEN 'dsm.tif' WHEN 2 THEN 'CHM.TIF' WHEN 3 THEN 'metadata.json' ELSE 'notes.txt' END AS f FROM events)
SELECT aoi_id, source_id, max(concat(aoi_id, '/', source_id, '/', f)) FILTER (f = 'dtm.tif') AS dtm_path, max(concat(aoi_id, '/', source_id, '/', f)) FILTER (f = 'CHM.TIF') AS chm_path, count(*) AS file_count FROM o GROUP BY ALL""")
def terrain_listing(t):
    """Terrain products and where they lie, per polygon."""
    k = c("event_id") % 5
    f = F.when(k == 0, "dtm.tif").when(k == 1, "dsm.tif").when(k == 2, "CHM.TIF").when(k == 3, "metadata.json").otherwise("notes.txt")
    o = t.events.select(F.concat(F.lit("aoi-"), c("user_id") % 5, F.lit("/polygon-"), c("event_id") % 200, F.lit("/"), f).alias("path")).distinct()
    o = o.withColumn("modified_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    return L.terrain_listing(o).select("aoi_id", "source_id", "dtm_path", "chm_path", "file_count")


@query("objects", "SELECT path, size_bytes FROM objects WHERE starts_with(path, 'aoi-3/scene-1')")
def objects_by_prefix(t):
    return L.with_prefix(t.objects, "aoi-3/scene-1").select("path", "size_bytes")


# --- reviewer texts -------------------------------------------------------------------

def narrated(t):
    p = S.score_pairs(event_pairs(t).join(t.assets.select("asset_id", "name"), "asset_id"))
    from landwatch.schema import ASSET_TYPES, name_of
    return p.withColumn("asset_type_name", name_of(ASSET_TYPES, c("asset_type")))


NAMED = """nm AS (SELECT s.*, a.name, e.asset_id FROM scored s JOIN risk_events e ON s.risk_event_id = e.risk_event_id JOIN assets a ON e.asset_id = a.asset_id)"""


@query("risk_events changes assets", f"""WITH {EVENT_PAIRS}, {SCORE}, {NAMED} SELECT risk_event_id, concat(CASE ndvi_code WHEN 'NDVI_DROP_SEVERE' THEN 'Severe vegetation loss' WHEN 'NDVI_DROP_STRONG' THEN 'Significant vegetation loss'
WHEN 'NDVI_DROP_MODERATE' THEN 'Moderate vegetation loss' WHEN 'NDVI_DROP_MILD' THEN 'Mild vegetation change' ELSE 'Vegetation change' END, ' detected ', CAST(distance_meters AS INT), 'm from ', name, '.',
CASE WHEN slope_code = 'SLOPE_UPSLOPE' THEN ' Change is upslope, increasing debris/erosion risk.' ELSE '' END) AS summary FROM nm""")
def event_sentences(t):
    """Sentence on what happened near which asset."""
    return narrated(t).select("risk_event_id", N.summary(c("factors"), c("name")).alias("summary"))


@query("risk_events changes assets", f"""WITH {EVENT_PAIRS}, {SCORE}, {NAMED}, ty AS (SELECT *, CASE asset_type WHEN 0 THEN 'TransmissionLine' WHEN 1 THEN 'Substation' WHEN 2 THEN 'GasPipeline' WHEN 3 THEN 'Building' WHEN 4 THEN 'Road' WHEN 5 THEN 'FireStation'
WHEN 6 THEN 'Hospital' WHEN 7 THEN 'School' WHEN 8 THEN 'WaterInfrastructure' ELSE 'Other' END AS tn FROM nm)
SELECT concat(CASE risk_level WHEN 'Critical' THEN concat('Immediate site inspection recommended. Consider protective measures for ', tn, '.') WHEN 'High' THEN concat('Schedule site inspection within 48 hours. Monitor for further changes near ', tn, '.')
WHEN 'Medium' THEN concat('Flag for review during next scheduled inspection of ', tn, '.') ELSE 'No immediate action required. Continue routine monitoring.' END,
CASE WHEN slope_code = 'SLOPE_UPSLOPE' AND risk_level IN ('High', 'Critical') THEN ' Upslope position warrants priority attention for slope stability.' ELSE '' END) AS action, count(*) AS events FROM ty GROUP BY 1""")
def suggested_actions(t):
    """Suggested actions and how many events get each."""
    a = N.suggested_action(c("factors"), c("risk_level"), c("asset_type_name"))
    return narrated(t).groupBy(a.alias("action")).agg(F.count("*").alias("events"))


@query("risk_events changes assets", f"""WITH {EVENT_PAIRS}, {SCORE}, f AS (SELECT 'Distance' AS name, distance_points AS p, 28 AS m FROM scored UNION ALL SELECT 'NDVI Drop', ndvi_points, 25 FROM scored UNION ALL SELECT 'Area', area_points, 15 FROM scored
UNION ALL SELECT 'Aspect', aspect_points, 5 FROM scored WHERE aspect_points IS NOT NULL UNION ALL SELECT 'Land Cover', 0, 0 FROM scored WHERE land_cover_class IS NOT NULL)
SELECT name, CASE WHEN m = 0 THEN 'multiplier' WHEN p / m >= 0.75 THEN 'critical' WHEN p / m >= 0.5 THEN 'high' WHEN p / m >= 0.25 THEN 'medium' ELSE 'low' END AS band, count(*) AS uses FROM f GROUP BY ALL""")
def factor_bands(t):
    """Bands of the factors' shares of their possible points."""
    f = S.score_pairs(event_pairs(t)).select(F.explode_outer("factors").alias("f")).select("f.*").where(c("name").isin("Distance", "NDVI Drop", "Area", "Aspect", "Land Cover"))
    return f.groupBy("name", N.factor_band(c("points"), c("max_points")).alias("band")).agg(F.count("*").alias("uses"))


@query("risk_events", """SELECT risk_event_id, CASE WHEN distance_meters < 1000 THEN concat(CAST(distance_meters AS INT), 'm') ELSE concat(CAST(floor((distance_meters + 50) / 1000) AS INT), '.', CAST(floor((distance_meters + 50) % 1000 / 100) AS INT), 'km') END AS distance_label,
concat(date_diff('day', created_at, TIMESTAMP '2024-01-01'), 'd ago') AS age_label FROM risk_events""")
def event_labels(t):
    """Distance and age labels of events."""
    return t.risk_events.select("risk_event_id", N.distance_label(c("distance_meters")).alias("distance_label"),
                    N.age_label(c("created_at"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("age_label"))


@query("aois", """SELECT aoi_id, CASE WHEN processing_schedule IS NULL THEN 'Not scheduled' ELSE 'Weekly (Monday)' END AS label FROM aois""")
def schedule_labels(t):
    return t.aois.select("aoi_id", N.schedule_label(c("processing_schedule")).alias("label"))


# --- small geometry ---------------------------------------------------------------------

@query("changes", """SELECT change_id, round(CASE o % 3 WHEN 0 THEN lon WHEN 1 THEN lon + half_size_deg ELSE lon + 0.002 END, 9) AS focus_x FROM (SELECT *, CAST(regexp_extract(change_id, '\\d+') AS BIGINT) AS o FROM changes)""")
def focus_points(t):
    """Point to show for an asset: the point, a line's nearest vertex, a polygon's centroid."""
    k = F.regexp_extract("change_id", r"(\d+)", 1).cast("long") % 3
    x, y, h = c("lon"), c("lat"), c("half_size_deg")
    geom = (F.when(k == 0, G.point(x, y)).when(k == 1, G.line(F.array(G.vertex(x + h * 3, y), G.vertex(x + h, y), G.vertex(x - h * 2, y))))
            .otherwise(G.box(x + 0.001, y, x + 0.003, y + h)))
    f = t.changes.withColumn("g", geom)
    return f.select("change_id", F.round(G.focus_point(c("g"), x, y)["x"], 9).alias("focus_x"))


@query("changes", f"""SELECT change_id, round(lon * pi() / 180 * 6378137, 3) AS mx, round(ln(tan(lat * pi() / 360 + pi() / 4)) * 6378137, 3) AS my, round((0.0001 + 0.0002) / 2 * (111320 + 111320 * cos(radians(lat))) / 2, 6) AS cell_m,
round(lon - half_size_deg - 100 / 111000.0::DOUBLE, 9) AS buffered_min_lon, round(lon, 9) AS center_lon FROM changes""")
def plane_coordinates(t):
    """Web Mercator positions, pixel size in metres, widened boxes and box centres."""
    h = c("half_size_deg")
    box = (c("lon") - h, c("lat") - h, c("lon") + h, c("lat") + h)
    return t.changes.select("change_id", F.round(P.mercator_x(c("lon")), 3).alias("mx"), F.round(P.mercator_y(c("lat")), 3).alias("my"),
                            F.round(P.cell_meters(F.lit(0.0001), F.lit(0.0002), c("lat"), F.lit(True)), 6).alias("cell_m"),
                            F.round(P.buffered_box(*box, F.lit(100.0))[0], 9).alias("buffered_min_lon"),
                            F.round(F.get(G.vertices(G.box_center(*box)), F.lit(0))["x"], 9).alias("center_lon"))


@query("aois", """SELECT aoi_id, CASE WHEN aoi_id = 'aoi-4' THEN NULL ELSE min_lon END AS first_x, CASE WHEN aoi_id = 'aoi-4' THEN NULL ELSE 5 END AS vertex_count FROM aois""")
def area_boxes(t):
    """Box polygons from four-number arrays; any other length gives null."""
    four = F.array("min_lon", "min_lat", "max_lon", "max_lat")
    b = G.box_from_array(F.when(c("aoi_id") == "aoi-4", F.slice(four, 1, 3)).otherwise(four))
    v = G.vertices(c("g"))
    return t.aois.withColumn("g", b).select("aoi_id", F.get(v, F.lit(0))["x"].alias("first_x"), F.when(c("g").isNotNull(), F.size(v)).alias("vertex_count"))


@query("embeddings", """SELECT vec_id, CASE WHEN vec_id % 4 IN (0, 1, 2) THEN NULL ELSE label::DOUBLE END AS cleaned FROM embeddings""")
def finite_values(t):
    """Infinite and undefined numbers become null."""
    from landwatch.functions.change import null_if_not_finite
    k = c("vec_id") % 4
    v = F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, float("-inf")).otherwise(c("label").cast("double"))
    return t.embeddings.select("vec_id", null_if_not_finite(v).alias("cleaned"))


@query("assets", f"""SELECT asset_type, count(*) AS matchable FROM (SELECT *, CAST(regexp_extract(asset_id, '\\d+') AS BIGINT) AS k FROM assets) WHERE k % 7 <> 0 AND k % 7 <> 1 AND NOT (k % 7 = 2 AND asset_type = 0) GROUP BY asset_type""")
def matchable_assets(t):
    """Assets the distance join looks at: overhead lines, missing and misplaced geometries are left out."""
    from landwatch.operators.proximity import matchable_assets as keep
    k = F.regexp_extract("asset_id", r"(\d+)", 1).cast("long") % 7
    x, y = c("lon"), c("lat")
    geom = (F.when(k == 0, None).when(k == 1, G.point(x * 1000, y)).when(k == 2, G.line(F.array(G.vertex(x, y), G.vertex(x + 0.01, y)))).otherwise(G.point(x, y)))
    return keep(t.assets.withColumn("geometry", geom)).groupBy("asset_type").agg(F.count("*").alias("matchable"))


@query("assets", """SELECT asset_id, true AS covers, true AS tight FROM assets""")
def degree_bounds(t):
    """Bounds in degrees of boxes given in UTM metres: they hold both corners and reach little further."""
    d = t.assets.withColumns({"zone": P.utm_zone(c("lon")), "south": F.lit(False), "lon2": c("lon") + 0.001, "lat2": c("lat") + 0.001})
    d = P.add_utm(d, "lon", "lat", "min_x", "min_y", "zone", "south")
    d = P.add_utm(d, "lon2", "lat2", "max_x", "max_y", "zone", "south")
    w = P.add_wgs84_bounds(d.withColumnsRenamed({"lon": "lon1", "lat": "lat1"}), "zone", "south")
    tiny, slack = 1e-9, 5e-5
    covers = (c("min_lon") <= c("lon1") + tiny) & (c("min_lat") <= c("lat1") + tiny) & (c("max_lon") >= c("lon2") - tiny) & (c("max_lat") >= c("lat2") - tiny)
    tight = (c("min_lon") > c("lon1") - slack) & (c("min_lat") > c("lat1") - slack) & (c("max_lon") < c("lon2") + slack) & (c("max_lat") < c("lat2") + slack)
    return w.select("asset_id", covers.alias("covers"), tight.alias("tight"))
