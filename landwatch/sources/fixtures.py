"""Adapter views that give the driver's tables the shapes of the domain.

Each text runs unchanged in Spark and in DuckDB; names in braces are tables or other adapters.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession

BASE = ("region nation customer supplier part orders lineitem events documents embeddings pages "
        "benchmark labels conversations").split()

ADAPTERS = {
    "aois": """
SELECT concat('aoi-', r_regionkey) AS aoi_id, r_name AS name,
       CAST(-121.70 + 0.20 * r_regionkey AS DOUBLE) AS min_lon, CAST(39.70 AS DOUBLE) AS min_lat,
       CAST(-121.55 + 0.20 * r_regionkey AS DOUBLE) AS max_lon, CAST(39.76 AS DOUBLE) AS max_lat,
       r_regionkey % 2 = 0 AS processing_enabled, 90 AS default_lookback_days, CAST(20 AS DOUBLE) AS max_cloud_cover,
       CASE WHEN r_regionkey = 3 THEN NULL ELSE '0 6 * * 1' END AS processing_schedule
FROM {region}""",
    "assets": """
SELECT concat('asset-', c_custkey) AS asset_id, concat('aoi-', n_regionkey) AS aoi_id, c_name AS name,
       CAST(CASE WHEN c_custkey % 10 = 9 THEN 99 ELSE c_custkey % 10 END AS INT) AS asset_type,
       CAST(c_custkey % 4 AS INT) AS criticality, c_mktsegment AS source_dataset,
       CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE CAST(200 + c_custkey * 17 % 900 AS DOUBLE) END AS asset_elevation_m,
       CAST(-121.70 + 0.20 * n_regionkey + 0.00015 * (c_custkey * 7919 % 1000) AS DOUBLE) AS lon,
       CAST(39.70 + 0.00006 * (c_custkey * 104729 % 1000) AS DOUBLE) AS lat
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "changes": """
SELECT concat('chg-', o_orderkey) AS change_id, concat('run-', o_orderkey % 5, '-', o_orderkey % 12) AS run_id,
       concat('aoi-', o_orderkey % 5) AS aoi_id,
       CAST(-121.70 + 0.20 * (o_orderkey % 5) + 0.00015 * (o_orderkey * 6151 % 1000) AS DOUBLE) AS lon,
       CAST(39.70 + 0.00006 * (o_orderkey * 3079 % 1000) AS DOUBLE) AS lat,
       CAST(0.0001 * (o_orderkey % 9 + 1) AS DOUBLE) AS half_size_deg,
       o_totalprice / 8 AS area_sq_meters,
       CAST(0.30 - 0.01 * (o_custkey % 120) AS DOUBLE) AS ndvi_drop_mean,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(0.1 * (o_orderkey * 17 % 450) AS DOUBLE) END AS slope_degree_mean,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(0.5 * (o_orderkey * 37 % 720) AS DOUBLE) END AS aspect_degrees,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(200 + o_orderkey * 11 % 900 AS DOUBLE) END AS elevation_m,
       CASE CAST(o_orderkey % 11 AS INT) WHEN 0 THEN 'AnnualCrop' WHEN 1 THEN 'Forest' WHEN 2 THEN 'HerbaceousVegetation'
            WHEN 3 THEN 'Highway' WHEN 4 THEN 'Industrial' WHEN 5 THEN 'Pasture' WHEN 6 THEN 'PermanentCrop'
            WHEN 7 THEN 'Residential' WHEN 8 THEN 'River' WHEN 9 THEN 'SeaLake' ELSE NULL END AS land_cover_class,
       o_orderkey % 13 = 0 AS is_landslide, o_orderdate AS detected_at
FROM {orders}""",
    "runs": """
SELECT concat('run-', o_orderkey % 5, '-', o_orderkey % 12) AS run_id, concat('aoi-', o_orderkey % 5) AS aoi_id,
       CAST((o_orderkey % 12) % 7 AS INT) AS status, min(o_orderdate) AS before_date, max(o_orderdate) AS after_date
FROM {orders} GROUP BY o_orderkey % 5, o_orderkey % 12""",
    "risk_events": """
SELECT concat(l_orderkey, '-', l_partkey, '-', l_suppkey, '-', l_linenumber) AS risk_event_id,
       concat('chg-', l_orderkey) AS change_id, concat('asset-', l_partkey % 150) AS asset_id,
       l_quantity * 50 AS distance_meters, CAST(floor(l_extendedprice / 1050) AS INT) AS risk_score,
       l_returnflag = 'A' AS is_acknowledged, l_returnflag = 'R' AND l_linestatus = 'F' AS is_dismissed,
       l_shipdate AS created_at
FROM {lineitem}""",
    "scenes": """
SELECT concat('scene-', event_id) AS scene_id, concat('aoi-', user_id % 5) AS aoi_id, ts AS acquired_at,
       value - 100 * floor(value / 100) AS cloud_cover, event_type AS platform, props AS properties_json
FROM {events}""",
    "pixels": """
SELECT CAST(floor(o_orderkey / 128) AS INT) AS row_idx, CAST(o_orderkey % 128 AS INT) AS col_idx,
       CAST(200 + o_custkey * 13 % 1800 AS INT) AS red_before, CAST(1500 + o_custkey * 29 % 3000 AS INT) AS nir_before,
       CAST(200 + CAST(floor(o_totalprice) AS BIGINT) % 1800 AS INT) AS red_after,
       CAST(500 + CAST(floor(o_totalprice / 3) AS BIGINT) % 4000 AS INT) AS nir_after,
       CAST(200 + (o_orderkey % 128) * 3 + o_custkey % 7 AS DOUBLE) AS elevation_m
FROM {orders}""",
    "points": """
SELECT CAST(l_partkey % 50 AS DOUBLE) + l_discount * 5 AS x, CAST(l_suppkey % 50 AS DOUBLE) + l_tax * 5 AS y,
       l_extendedprice / 1000 AS z, CAST(CASE l_returnflag WHEN 'A' THEN 2 WHEN 'R' THEN 5 ELSE 1 END AS INT) AS classification,
       CAST(l_linenumber % 3 + 1 AS INT) AS return_number
FROM {lineitem}""",
    "open_way_nodes": """
SELECT l_orderkey AS way_id, l_partkey AS node_id,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS pos
FROM {lineitem}""",
    # Every third way returns to its first node; every seventh node is not in the extract.
    "way_nodes": """
SELECT way_id, node_id, pos FROM {open_way_nodes}
UNION ALL SELECT way_id, node_id, 1000000 AS pos FROM {open_way_nodes} WHERE pos = 1 AND way_id % 3 = 0""",
    "nodes": """
SELECT p_partkey AS node_id, CAST(-121.70 + 0.0001 * (p_partkey * 31 % 1500) AS DOUBLE) AS lon,
       CAST(39.70 + 0.0001 * (p_partkey * 17 % 600) AS DOUBLE) AS lat, p_type AS tag
FROM {part} WHERE p_partkey % 7 <> 6""",
    # Properties of raw map features from nine sources and an unknown one.
    "raw_features": """
SELECT p_partkey AS seq,
       CASE CAST(p_partkey % 10 AS INT) WHEN 0 THEN 'osm_buildings' WHEN 1 THEN 'osm_roads' WHEN 2 THEN 'osm_power' WHEN 3 THEN 'cec_transmission'
            WHEN 4 THEN 'cec_substations' WHEN 5 THEN 'eia_pipelines' WHEN 6 THEN 'hifld_fire_stations' WHEN 7 THEN 'hifld_hospitals'
            WHEN 8 THEN 'hifld_schools' ELSE 'other' END AS source,
       CASE WHEN p_partkey % 13 < 3 THEN p_name WHEN p_partkey % 13 = 3 THEN '' END AS feature_name,
       CASE WHEN p_partkey % 17 = 1 THEN p_brand END AS upper_name,
       CASE CAST(floor(p_partkey / 10) % 6 AS INT) WHEN 0 THEN 'hospital' WHEN 1 THEN 'school' WHEN 2 THEN 'retail' WHEN 3 THEN 'yes' WHEN 4 THEN 'college' END AS building,
       CASE CAST(floor(p_partkey / 10) % 6 AS INT) WHEN 0 THEN 'motorway' WHEN 1 THEN 'tertiary' WHEN 2 THEN 'service' WHEN 3 THEN 'track' WHEN 4 THEN 'primary' END AS highway,
       CASE CAST(floor(p_partkey / 10) % 6 AS INT) WHEN 0 THEN 'line' WHEN 1 THEN 'minor_line' WHEN 2 THEN 'tower' WHEN 3 THEN 'pole' WHEN 4 THEN 'generator' END AS power,
       CASE WHEN p_size % 4 <> 0 THEN p_size * 6 END AS voltage, CASE WHEN p_size % 3 <> 0 THEN p_type END AS owner,
       CASE WHEN p_size % 2 = 0 THEN p_type END AS typepipe, CASE WHEN p_size % 5 <> 0 THEN p_brand END AS street,
       CASE WHEN p_size % 3 = 1 THEN '12' END AS housenumber
FROM {part}""",
    # Entities as the store keeps them.
    "stored_events": """
SELECT risk_event_id, change_id, asset_id, distance_meters, risk_score,
       CASE WHEN risk_score >= 75 THEN 3 WHEN risk_score >= 50 THEN 2 WHEN risk_score >= 25 THEN 1 ELSE 0 END AS risk_level,
       CASE WHEN is_acknowledged THEN created_at END AS acknowledged_at,
       CASE WHEN is_dismissed THEN created_at END AS dismissed_at, created_at
FROM {risk_events}""",
    "stored_changes": """
SELECT change_id, run_id, lon, lat, half_size_deg, area_sq_meters, ndvi_drop_mean,
       ndvi_drop_mean + CAST(0.1 AS DOUBLE) AS ndvi_drop_max,
       CASE WHEN is_landslide THEN 6 WHEN ndvi_drop_mean < -0.2 THEN 1 WHEN ndvi_drop_mean > 0.2 THEN 2 ELSE 0 END AS change_type,
       slope_degree_mean, detected_at, land_cover_class,
       CASE WHEN is_landslide THEN CAST(0.8 AS DOUBLE) END AS ml_confidence,
       CASE WHEN is_landslide THEN CASE WHEN area_sq_meters > 30000 THEN 'v2' ELSE 'v1' END END AS ml_model_version
FROM {changes}""",
    "stored_runs": """
SELECT run_id, aoi_id, status, before_date, after_date, after_date AS created_at FROM {runs}""",
    # Runs with scenes and dates of the scene period, so that catalog checks have something to skip.
    "scene_runs": """
SELECT concat('run-s-', user_id % 5, '-', user_id % 20) AS run_id, concat('aoi-', user_id % 5) AS aoi_id,
       CAST(CASE WHEN user_id % 5 = 4 AND user_id % 20 >= 15 THEN 3 ELSE 5 END AS INT) AS status,
       min(ts) AS before_date, min(CASE WHEN user_id % 5 = 2 THEN NULL WHEN event_id % 20 < 3 THEN ts END) AS after_date,
       concat('scene-', min(event_id)) AS before_scene_id, concat('scene-', max(event_id)) AS after_scene_id,
       max(ts) AS created_at
FROM {events} GROUP BY user_id % 5, user_id % 20""",
    # Stored object listing: aoi/scene/file.
    "objects": """
SELECT concat('aoi-', user_id % 5, '/scene-', event_id % 97, '/', event_type, '-', event_id % 7,
              CASE WHEN event_id % 4 = 0 THEN '.png' WHEN event_id % 4 = 1 THEN '.json' ELSE '.tif' END) AS path,
       CAST(round(value * 1000) AS BIGINT) AS size_bytes, ts AS modified_at
FROM {events}""",
    # Square zones in pixel space (x = col * 10, y = -row * 10).
    "zones": """
SELECT concat('zone-', c_custkey) AS zone_id, CAST(c_custkey * 37 % 1280 AS DOUBLE) AS zx,
       CAST(-(c_custkey * 53 % (SELECT 10 * (max(row_idx) + 1) FROM {pixels})) AS DOUBLE) AS zy, CAST(12.5 + c_custkey % 40 AS DOUBLE) AS half_m
FROM {customer}""",
    # 8x8 patches from the embeddings.
    "patches": """
SELECT vec_id AS patch_id, embedding AS logits, label FROM {embeddings}""",
}


def _needs(text: str) -> list[str]:
    return [f for _, f, _, _ in string.Formatter().parse(text) if f]


def oracle(names: str, body: str) -> str:
    """DuckDB text: the named adapters (and what they need) as common table expressions."""
    order: list[str] = []

    def visit(name: str):
        if name in BASE or name in order:
            return
        for dep in _needs(ADAPTERS[name]):
            visit(dep)
        order.append(name)

    for name in names.split():
        visit(name)
    ctes = ", ".join(f"{n} AS ({ADAPTERS[n].format(**{d: d for d in _needs(ADAPTERS[n])})})" for n in order)
    body = body.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes}, {body[14:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"


class Tables:
    """Base tables and adapter views of one folder, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._seen = spark, folder, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._seen:
            if name in BASE:
                self._seen[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            elif name in ADAPTERS:
                text = ADAPTERS[name]
                self._seen[name] = self.spark.sql(text, **{d: getattr(self, d) for d in _needs(text)})
            else:
                raise AttributeError(name)
        return self._seen[name]
