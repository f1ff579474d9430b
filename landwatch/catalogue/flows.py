"""Whole flows: rasters to risk events, and the streaming twins."""

import uuid

import numpy as np
from pyspark.sql import functions as F

from landwatch.catalogue.catalog import CHECK, LOG, now, run_log
from landwatch.catalogue.rasters import NEIGHBOR, REC, grid, long_bands, terrain
from landwatch.catalogue.registry import query
from landwatch.catalogue.sqltext import CHANGE_TYPE, LEVEL_NAME, SCORE
from landwatch.config import ProcessingConfig
from landwatch.functions import geometry as G
from landwatch.functions import projection as P
from landwatch.operators import patches
from landwatch.operators.ranking import first_by
from landwatch.plans.change_to_risk import change_to_risk
from landwatch.schema import LAND_COVER_CLASSES
from landwatch.session import cut_lineage, shared_dir
from landwatch.sources.fixtures import Tables
from landwatch.streaming import jobs

c = F.col
X0, Y0 = 610000.0, 4400000.0


def flow(t, **models):
    """Rasters, elevation and assets of one area laid on a UTM grid of ten-metre pixels."""
    key = [F.lit("aoi-0").alias("aoi_id"), F.lit("run-0").alias("run_id")]
    bands = long_bands(t).where("band IN ('B04', 'B08') AND scene_id <> 's-odd'").select(
        *key, F.replace("scene_id", F.lit("s-"), F.lit("")).alias("side"), "band", "row_idx", "col_idx", "value")
    size = t.pixels.agg((F.max("row_idx") + 1).alias("rows"), F.lit(128).alias("cols"))
    rasters = size.select(*key, F.lit(X0).alias("x0"), F.lit(Y0).alias("y0"), F.lit(10.0).alias("dx"), F.lit(-10.0).alias("dy"),
                          F.lit(10).alias("zone"), F.lit(False).alias("south"), "rows", "cols")
    dem = t.pixels.select(*key, "row_idx", "col_idx", "elevation_m")
    k = c("c_custkey")
    a = t.customer.select(F.concat(F.lit("asset-"), k).alias("asset_id"), F.lit("aoi-0").alias("aoi_id"), (k % 9 + 1).cast("int").alias("asset_type"),
                          (k % 4).cast("int").alias("criticality"), (k * 7919 % 12800 / 10 + 0.03 + X0).alias("ax"), (F.lit(Y0) - k * 3571 % 11700 / 10 - 0.03).alias("ay"),
                          F.lit(10).alias("zone"), F.lit(False).alias("south"))
    a = P.add_lonlat(a, "ax", "ay", "zone", "south").withColumn("geometry", G.point(c("lon"), c("lat")))
    # Assets come as a written table, as in a store, not as an expression to be inlined everywhere.
    a = cut_lineage(a.select("asset_id", "aoi_id", "asset_type", "criticality", "geometry"))
    return change_to_risk(bands, rasters, a, dem,
                          config=ProcessingConfig(min_area_m2=1000.0, max_distance_m=120.0, tile_size=64), **models)


# Regions as pixel squares; distance to a region is the least distance to its squares.
FLOW = REC + f""", sz AS (SELECT component_id, count(*) AS pixels, avg(d::DOUBLE) AS ndvi_drop_mean, CAST(floor(avg(k) + 0.5) AS INT) AS ck, CAST(floor(avg(r) + 0.5) AS INT) AS cr FROM comp JOIN px USING (id) GROUP BY 1 HAVING count(*) >= 10),
{NEIGHBOR},
zt AS (SELECT cp.component_id, avg(t.elevation_m) AS e, avg(slope_deg::DOUBLE) AS s, degrees(atan2(avg(sin(radians(aspect_deg::DOUBLE))), avg(cos(radians(aspect_deg::DOUBLE))))) AS a
 FROM comp cp JOIN px USING (id) JOIN ter t ON t.row_idx = px.r AND t.col_idx = px.k GROUP BY 1),
ast AS (SELECT concat('asset-', c_custkey) AS asset_id, CAST(c_custkey % 4 AS INT) AS criticality, c_custkey * 7919 % 12800 / 10.0 + 0.03 AS ax, c_custkey * 3571 % 11700 / 10.0 + 0.03 AS ay FROM customer),
ht AS (SELECT ast.*, p.elevation_m AS asset_elevation_m FROM ast LEFT JOIN pixels p ON p.col_idx = least(127, floor(ax / 10)) AND p.row_idx = least((SELECT max(row_idx) FROM pixels), floor(ay / 10))),
dd AS (SELECT component_id, asset_id, min(sqrt(pow(greatest(k * 10 - ax, 0, ax - k * 10 - 10), 2) + pow(greatest(r * 10 - ay, 0, ay - r * 10 - 10), 2))) AS distance_meters
 FROM ast JOIN px ON ax BETWEEN k * 10 - 120 AND k * 10 + 130 AND ay BETWEEN r * 10 - 120 AND r * 10 + 130 JOIN comp USING (id) GROUP BY 1, 2 HAVING distance_meters <= 120),
pairs AS (SELECT dd.*, sz.ndvi_drop_mean, sz.pixels * 100.0 AS area_sq_meters, zt.s AS slope_degree_mean, CASE WHEN zt.a < 0 THEN zt.a + 360 ELSE zt.a END AS aspect_degrees, NULL::VARCHAR AS land_cover_class,
 'VegetationLoss' AS change_type, ht.criticality, pc.elevation_m - ht.asset_elevation_m AS elevation_diff_m FROM dd JOIN sz USING (component_id) JOIN zt USING (component_id) JOIN ht USING (asset_id) LEFT JOIN pixels pc ON pc.row_idx = cr AND pc.col_idx = ck),
{SCORE}"""


@query("pixels", FLOW + """ SELECT component_id // 128 * 2147483648 + component_id % 128 AS component_id, asset_id, round(distance_meters, 3)::DOUBLE AS distance_m, elevation_diff_m, risk_score, risk_level FROM scored""")
def events_from_rasters(t):
    """Risk events from two dates of bands: index, difference, regions, terrain, distance join and scores."""
    e = flow(t)["risk_events"]
    return e.select("component_id", "asset_id", F.round("distance_meters", 3).alias("distance_m"), "elevation_diff_m", "risk_score", "risk_level")


@query("pixels", FLOW + """ SELECT (SELECT count(*) FROM sz) AS polygon_count, count(*) AS risk_event_count, false AS has_land_cover, NULL::VARCHAR AS ml_model_version FROM scored""")
def flow_summary(t):
    """Counts of the whole flow per run."""
    return flow(t)["summary"].drop("aoi_id", "run_id")


# --- the flow with models -----------------------------------------------------------------

BANDS = ["red_after", "nir_after", "red_before", "nir_before"]
MEANS, STDS = [1500.0] * 12 + [17.0, 400.0], [800.0] * 12 + [10.0, 40.0]


def cover_scores():
    """Stand-in for a trained network: ten class scores from the mean of the first channel."""
    return lambda block: np.stack([-np.abs((block[:, 0].mean((1, 2)) * 10000 - 700) / 80 - k) for k in range(10)], 1)


def slide_scores():
    """Stand-in for a trained network: a score a pixel from twelve bands, slope and elevation."""
    return lambda block: block[:, :12].mean(1) + block[:, 12] + block[:, 13]


def channels(t):
    """Pixels with fourteen channels: twelve bands (four, each at three offsets), slope and elevation."""
    bands = [(c(BANDS[i % 4]) + 50 * i).alias(f"ch{i}") for i in range(12)]
    p = t.pixels.select("row_idx", "col_idx", *bands, c("elevation_m").alias("ch13"))
    return p.join(terrain(t).select("row_idx", "col_idx", c("slope_deg").alias("ch12")), ["row_idx", "col_idx"])


def models(t):
    """Hooks that cut patches around changes and run both models on them."""
    g, pixels, names = grid(t), cut_lineage(channels(t)), [f"ch{i}" for i in range(14)]
    places = lambda changes: changes.select("change_id", "slope_degree_mean", (c("c_col") * 10).alias("px"), (c("c_row") * -10).alias("py"))

    def around(changes, size, values):
        return patches.dense_patches(patches.patch_pixels(places(changes), pixels, g, "change_id", "px", "py", size, values), "change_id", size, values)

    def land_cover(changes):
        found = patches.classify_land_cover(around(changes, 8, ["ch0"]), "change_id", cover_scores, 8)
        return found.select("change_id", c("dominant_class").alias("land_cover_class"))

    def landslides(changes):
        return patches.classify_landslides(changes, around(changes, 32, names), "change_id", slide_scores, MEANS, STDS, size=32)

    return {"land_cover": land_cover, "landslides": landslides}


AROUND = "{0} AS (SELECT component_id, {1} FROM sz CROSS JOIN (SELECT max(row_idx) + 1 AS h FROM pixels) JOIN pixels p ON p.row_idx >= cr - {2} AND p.row_idx < cr + {2} AND p.col_idx >= ck - {2} AND p.col_idx < ck + {2} {3})"
SLIDE = "1 / (1 + exp(-((({0}) - 1500) / 800.0 + ({1} - 17) / 10.0 + ({2} - 400) / 40.0)))"
MODELS = f"""{AROUND.format('cv', 'CAST(least(9, greatest(0, round((sum(red_after) / 64.0 - 700) / 80))) AS INT) AS cls', 4, 'GROUP BY 1')},
lcv AS (SELECT component_id, {LAND_COVER_CLASSES!r}[cls + 1] AS land_cover_class FROM cv),
{AROUND.format('sp', SLIDE.format('(red_after + nir_after + red_before + nir_before) / 4.0 + 275', 'slope_deg', 'p.elevation_m') + ' AS p', 16, 'JOIN ter USING (row_idx, col_idx)')},
sv AS (SELECT component_id, (sum(p) + (1024 - count(*)) * {SLIDE.format('0', '0', '0')}) / 1024 > 0.35 AND count(*) FILTER (p > 0.5) / 1024.0 > 0.15 AS slide FROM sp GROUP BY 1),
typ AS (SELECT component_id, land_cover_class, CASE WHEN slide AND zt.s >= 10 THEN 'LandslideDebris' ELSE {CHANGE_TYPE} END AS change_type FROM sz JOIN lcv USING (component_id) JOIN sv USING (component_id) JOIN zt USING (component_id)),
pairs AS ("""
FLOW_MODELS = FLOW.replace("\npairs AS (", "\n" + MODELS).replace("NULL::VARCHAR AS land_cover_class,\n 'VegetationLoss' AS change_type", "typ.land_cover_class,\n typ.change_type").replace(
    "JOIN zt USING (component_id) JOIN ht", "JOIN zt USING (component_id) JOIN typ USING (component_id) JOIN ht")


@query("pixels", FLOW_MODELS + """ SELECT component_id // 128 * 2147483648 + component_id % 128 AS component_id, asset_id, land_cover_class, change_type, risk_score, risk_level FROM scored""")
def events_with_models(t):
    """Risk events of the whole flow with a land-cover and a fourteen-channel landslide model run on patches around the changes."""
    e = flow(t, **models(t))["risk_events"]
    return e.select("component_id", "asset_id", "land_cover_class", "change_type", "risk_score", "risk_level")


# --- streams ------------------------------------------------------------------------------

def streamed(t, table):
    """The tables with one of them read as a stream of files."""
    s = Tables(t.spark, t.folder)
    base = getattr(t, table)
    s._seen[table] = t.spark.readStream.schema(base.schema).parquet(f"{t.folder}/{table}*.parquet")
    return s


def places(t):
    root = f"{shared_dir(t.spark)}/streams/{uuid.uuid4().hex}"
    return f"{root}/out", f"{root}/progress"


@query("aois scene_runs scenes", f"""WITH {CHECK} SELECT aoi_id, scene_id, cloud_cover, recommended_before_date::TIMESTAMP AS before_date, recommended_after_date::TIMESTAMP AS after_date FROM ck WHERE new_data""")
def streamed_scene_runs(t):
    """Scene stream to candidate runs; the newest candidate per area equals the batch check."""
    out, progress = places(t)
    jobs.new_scene_job(streamed(t, "events").scenes.drop("properties_json", "platform"), t.aois, t.scene_runs, now(), out, progress).awaitTermination()
    rows = t.spark.read.parquet(out).drop("batch")
    best = first_by(rows, ["aoi_id"], [-F.unix_micros("acquired_at"), c("scene_id")])
    return best.select("aoi_id", "scene_id", "cloud_cover", c("before_day").cast("timestamp_ntz").alias("before_date"), c("after_day").cast("timestamp_ntz").alias("after_date"))


@query("stored_events", f"""SELECT risk_event_id, channel, risk_level, {LEVEL_NAME.format('risk_level')} AS level_name FROM
(SELECT *, 'webhook' AS channel FROM stored_events WHERE risk_level >= 3 UNION ALL SELECT *, 'email' FROM stored_events WHERE risk_level >= 2)""")
def streamed_alerts(t):
    """Event stream to alert rows; equals the batch routing."""
    out, progress = places(t)
    jobs.alert_job(streamed(t, "lineitem").stored_events, out, progress).awaitTermination()
    return t.spark.read.parquet(out).select("risk_event_id", "channel", "risk_level", F.get_json_object("payload", "$.riskLevel").alias("level_name"))


@query("", f"""WITH {LOG}, w AS (SELECT *, coalesce(lag(status) OVER (PARTITION BY run_id ORDER BY tick, seq), 0) AS was FROM lg)
SELECT run_id, arg_max(status, (tick, seq)) AS status, min(tick) FILTER (status = 1 AND was <> 1) AS started_at, max(tick) FILTER (status IN (5, 6) AND was <> status) AS completed_at,
arg_max(before_scene_id, (tick, seq)) FILTER (before_scene_id <> '') AS before_scene_id FROM w GROUP BY run_id""")
def streamed_run_states(t):
    """Status-log stream to run states; equals the batch fold."""
    out, progress = places(t)
    jobs.run_state_job(run_log(streamed(t, "events")), out, progress).awaitTermination()
    s = jobs.newest_state(t.spark.read.parquet(f"{out}/state"))
    return s.select("run_id", "status", c("started_at").cast("timestamp_ntz").alias("started_at"), c("completed_at").cast("timestamp_ntz").alias("completed_at"), "before_scene_id")
