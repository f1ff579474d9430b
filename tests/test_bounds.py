"""Nothing is cut: data beyond former bounds, NaN bands, late stream rows, weights and long ids."""

import math

from pyspark.sql import functions as F

from landwatch.functions.change import ndvi
from landwatch.operators import lists, loads, pointcloud, raster, training
from landwatch.plans.executor import execute_plan
from landwatch.plans.query_plan import load_plan
from landwatch.sources import geojson, scenes
from landwatch.streaming import jobs

c = F.col


def test_scene_beyond_the_newest_hundred_wins(spark):
    rows = spark.range(400).select(F.lit("a").alias("aoi_id"), F.format_string("s%03d", "id").alias("scene_id"), F.lit(5.0).alias("cloud_cover"),
                                   F.timestamp_seconds(1_704_067_200 + 900 * c("id")).cast("timestamp_ntz").alias("acquired_at"))
    target = spark.sql("select 'a' as aoi_id, timestamp_ntz'2024-01-01 00:00:00' as target_at")
    assert scenes.best_scenes(rows, target).first().days_off == 0
    assert scenes.search(rows, "2024-01-01", "2024-02-01").count() == 400 and scenes.search(rows, "2024-01-01", "2024-02-01", max_items=7).count() == 7


def test_tiles_pages_features_and_plans_are_whole(spark):
    tiles = spark.range(900).select(F.format_string("t%04d", "id").alias("tile_id"), F.lit(0.0).alias("min_x"), F.lit(0.0).alias("min_y"), F.lit(1.0).alias("max_x"), F.lit(1.0).alias("max_y"),
                                    F.create_map(F.when(c("id") % 2 == 0, "data").otherwise("thumb"), F.struct(F.lit("u").alias("href"))).alias("assets"))
    assert pointcloud.search_tiles(tiles, (0, 0, 1, 1)).count() == 450
    assets = spark.range(12_000).select(F.format_string("a%05d", "id").alias("asset_id"), F.lit("x").alias("aoi_id"), F.lit("n").alias("name"), F.lit(4).alias("asset_type"),
                                        F.lit(2).alias("criticality"), F.lit("s").alias("source_dataset"), F.lit(None).cast("timestamp_ntz").alias("created_at"))
    assert lists.list_assets(assets, "x", take=5000).count() == 5000
    from landwatch.functions.geometry import point
    assert geojson.asset_features(assets.withColumn("geometry", point(F.lit(1.0), F.lit(2.0))), "x").count() == 12_000
    plan = load_plan({"targetEntity": "Asset"})
    assert execute_plan({"assets": assets}, plan).items.count() == 12_000
    assert execute_plan({"assets": assets}, load_plan({"targetEntity": "Asset", "limit": 500})).items.count() == 500


def test_nan_bands_stay_unknown(spark):
    df = spark.createDataFrame([(math.nan, 1.0), (1.0, math.nan), (1.0, 3.0)], "r double, n double")
    got = [r[0] for r in df.select(ndvi(c("r"), c("n"))).collect()]
    assert math.isnan(got[0]) and math.isnan(got[1]) and got[2] == 0.5
    px = spark.createDataFrame([(0, 0, math.nan, 0.5), (0, 1, 0.5, math.nan), (0, 2, 0.5, 0.1)], "row_idx int, col_idx int, b float, a float")
    d = raster.difference(px.select("row_idx", "col_idx", c("b").alias("ndvi")), px.select("row_idx", "col_idx", c("a").alias("ndvi")), [])
    assert [r.changed for r in d.orderBy("col_idx").collect()] == [0, 0, 1]
    s = raster.change_statistics(d, []).first()
    assert s.changed_pixels == 1 and abs(s.mean_diff + 0.4) < 1e-6 and abs(s.max_diff + 0.4) < 1e-6
    assert raster.ndvi_statistics(px, [], "b").first().max_value == 0.5


def test_draws_take_any_weight(spark):
    w = spark.range(6000).select(c("id").alias("k"), F.element_at(F.array(F.lit(0.0), F.lit(0.5), F.lit(2.0)), (c("id") % 3 + 1).cast("int")).alias("weight"))
    n = {r[0]: r[1] for r in training.weighted_draws(w, "k", 3, buckets=8).groupBy(c("k") % 3).count().collect()}
    assert sum(n.values()) == 6000 and 0 not in n and abs(n[1] / 6000 - 0.2) < 0.03 and abs(n[2] / 6000 - 0.8) < 0.03


def test_ids_of_long_areas_differ(spark):
    df = spark.range(5).select(loads.make_asset_id(F.lit("area-" + "x" * 40), c("id").cast("string")).alias("i"))
    assert df.distinct().count() == 5


def test_late_alerts_are_not_lost(spark, tmp_path):
    kinds = "risk_event_id string, asset_id string, risk_score int, risk_level int, distance_meters double, created_at timestamp"
    for n, day in enumerate(("2024-06-30", "2024-06-01", "2024-01-01")):
        rows = spark.range(10).select(F.format_string(f"{n}-%d", "id").alias("risk_event_id"), F.lit("a").alias("asset_id"), F.lit(90).alias("risk_score"), F.lit(3).alias("risk_level"),
                                      F.lit(1.0).alias("distance_meters"), F.lit(day).cast("timestamp").alias("created_at"))
        rows.unionByName(rows.limit(2)).write.parquet(f"{tmp_path}/in/part={n}")
        stream = spark.readStream.schema(kinds + ", part int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        jobs.alert_job(stream.drop("part"), f"{tmp_path}/out", f"{tmp_path}/progress", {"email": 2}).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").select("risk_event_id").collect()
    assert len(got) == 30 and len({r[0] for r in got}) == 30
