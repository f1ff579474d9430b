import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from landwatch.functions import change as C
from landwatch.functions import geometry as G
from landwatch.operators import raster as R
from landwatch.operators import terrain as T

c = F.col


def test_ndvi_golden_values(spark):
    rows = [(100, 400, 0.6), (300, 350, 50 / 650), (500, 200, -300 / 700), (250, 250, 0.0), (1, 9999, 0.9998), (9999, 1, -0.9998), (0, 0, 0.0)]
    df = spark.createDataFrame([(float(a), float(b), w) for a, b, w in rows], "r double, n double, want double")
    for r in df.select(C.ndvi(c("r"), c("n")).alias("v"), "want").collect():
        assert abs(r.v - r.want) < 1e-6


@pytest.mark.parametrize("nodata,want", [(-9999, -1.0), (9999, 1.0), (-5, -1.0), (0.5, 0.5)])
def test_nodata_is_clipped(spark, nodata, want):
    assert spark.range(1).select(C.ndvi(F.lit(5), F.lit(-5), nodata)).collect()[0][0] == want


def test_statistics_of_empty_and_zero_rasters(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 0.0), ("b", 0.5), ("b", 0.0), ("b", -0.1)], "s string, ndvi double")
    got = {r.s: (r.min_value, r.max_value, r.mean_value) for r in R.ndvi_statistics(df, ["s"]).collect()}
    assert got["a"] == (-1.0, 1.0, 0.0) and got["b"] == (-0.1, 0.5, 0.2)


def test_mask_is_strict_and_ignores_nan(spark):
    df = spark.createDataFrame([(-0.2,), (-0.21,), (float("nan"),), (None,), (0.3,)], "d float")
    assert [r[0] for r in df.select(C.changed(c("d"))).collect()] == [0, 1, 0, 0, 0]


def test_change_types_by_land_cover(spark):
    rows = [(-0.5, "Forest", "FireBurnScar"), (-0.5, "AnnualCrop", "AgriculturalChange"), (-0.5, "River", "VegetationLoss"), (-0.4, "Forest", "VegetationLoss"),
            (-0.3, "Pasture", "DroughtStress"), (-0.3, "PermanentCrop", "AgriculturalChange"), (-0.3, None, "VegetationLoss"), (-0.2, "Pasture", "Unknown"),
            (0.2, None, "Unknown"), (0.21, "Forest", "VegetationGain")]
    df = spark.createDataFrame(rows, "d double, lc string, want string")
    assert all(r.got == r.want for r in df.select(C.change_type(c("d"), c("lc")).alias("got"), "want").collect())


def test_empty_difference_gives_zeros(spark):
    empty = spark.createDataFrame([], "ndvi_diff double, changed int")
    r = R.change_statistics(empty, []).collect()[0]
    assert (r.mean_diff, r.total_pixels, r.change_percent) == (0.0, 0, 0.0)


def plain_horn(z, cell, true=False):
    """Direct form of the stencil with repeated edges and missing cells as 0."""
    hole = np.isnan(z)
    p = np.pad(np.where(hole, 0, z), 1, mode="edge")
    s, a = np.full(z.shape, np.nan), np.full(z.shape, np.nan)
    for i in range(z.shape[0]):
        for j in range(z.shape[1]):
            if hole[i, j]:
                continue
            w = p[i:i + 3, j:j + 3]
            dx = ((w[0, 0] + 2 * w[1, 0] + w[2, 0]) - (w[0, 2] + 2 * w[1, 2] + w[2, 2])) / (8 * cell)
            dy = ((w[2, 0] + 2 * w[2, 1] + w[2, 2]) - (w[0, 0] + 2 * w[0, 1] + w[0, 2])) / (8 * cell)
            s[i, j] = math.degrees(math.atan(math.hypot(dx, dy)))
            a[i, j] = math.degrees(math.atan2(dx if true else -dx, dy)) % 360
    return s, a


@pytest.mark.parametrize("true", [False, True])
def test_slope_and_aspect_across_tiles(spark, true):
    z = np.random.default_rng(4).uniform(0, 100, (13, 17))
    z[5, 5] = z[0, 16] = np.nan
    df = spark.createDataFrame([("k", r, k, None if np.isnan(z[r, k]) else float(z[r, k])) for r in range(13) for k in range(17)],
                               "key string, row_idx int, col_idx int, elevation_m double")
    s, a = plain_horn(z, 5.0, true)
    got = T.slope_aspect(df, ["key"], 5.0, tile=4, east_west="true" if true else "stored").collect()
    assert len(got) == 13 * 17
    for r in got:
        if np.isnan(z[r.row_idx, r.col_idx]):
            assert r.slope_deg is None and r.aspect_deg is None
        else:
            assert abs(r.slope_deg - s[r.row_idx, r.col_idx]) < 1e-4 and abs((r.aspect_deg - a[r.row_idx, r.col_idx] + 180) % 360 - 180) < 1e-3


def test_aspect_points_down_the_slope(spark):
    df = spark.createDataFrame([(r, k, float(100 - 10 * k)) for r in range(3) for k in range(3)], "row_idx int, col_idx int, elevation_m double")
    one = lambda mode: [r for r in T.slope_aspect(df, [], 10.0, east_west=mode).collect() if (r.row_idx, r.col_idx) == (1, 1)][0].aspect_deg
    assert one("true") == 90.0 and one("stored") == 270.0


def test_circular_mean_crosses_north(spark):
    df = spark.createDataFrame([(350.0,), (10.0,), (5.0,)], "a double")
    assert abs(df.agg(T.circular_mean("a")).collect()[0][0] - 1.6735) < 0.01


def test_dem_choice_falls_back(spark):
    df = spark.createDataFrame([("a", "3dep", "t1", 0, 0, 1.0), ("a", "3dep", "t2", 0, 0, 2.0), ("b", "3dep", "t1", 0, 0, 3.0), ("b", "lidar", "l", 0, 0, 4.0)],
                               "area string, source string, tile_id string, row_idx int, col_idx int, elevation_m double")
    got = lambda s: sorted((r.area, r.elevation_m) for r in T.choose_dem(df, s, ["area"]).collect())
    assert got("lidar") == [("a", 1.0), ("b", 4.0)] and got("3dep") == [("a", 1.0), ("b", 3.0)] and got("moon") == []


def test_band_stack_needs_reference_and_four_bands(spark):
    rows = [("s1", b, 0, 0, 7.0) for b in ("B02", "B03", "B04", "B08")] + [("s2", b, 0, 0, 7.0) for b in ("B02", "B03", "B04")] + [("s3", b, 0, 0, 7.0) for b in ("B01", "B03", "B04", "B08")]
    df = spark.createDataFrame(rows, "scene_id string, band string, row_idx int, col_idx int, value double")
    got = R.band_stack(df, ["scene_id"], ["B01", "B02", "B03", "B04", "B08"]).collect()
    assert [(r.scene_id, r.B01, r.B08) for r in got] == [("s1", 0.0, 7.0)]


def test_rasters_are_written_under_their_keys(spark, tmp_path):
    df = spark.createDataFrame([("s1", "B04", r, k, 1.0) for r in range(4) for k in range(4)] + [("s1", "B08", 0, 0, 2.0)],
                               "scene_id string, band string, row_idx int, col_idx int, value double")
    R.write_bands(df, str(tmp_path / "bands"))
    back = spark.read.parquet(str(tmp_path / "bands"))
    assert back.where("band = 'B04'").count() == 16 and (tmp_path / "bands" / "scene_id=s1" / "band=B08").exists()
    d = spark.createDataFrame([("r1", 0, 0, -0.5, 1)], "run_id string, row_idx int, col_idx int, ndvi_diff double, changed int")
    R.write_change_rasters(d, str(tmp_path / "diff"), ["run_id"])
    assert dict(spark.read.parquet(str(tmp_path / "diff")).dtypes)["changed"] == "tinyint"


def test_spans_of_zones_are_dealt_and_never_broadcast(spark, tmp_path):
    """A file of few zones may hold any number of spans, so its size must not decide how they meet the pixels."""
    zones = spark.range(40).selectExpr("concat('z', id) AS zone_id", "CAST(id * 3 % 60 AS DOUBLE) AS x", "CAST(-(id * 7 % 50) AS DOUBLE) AS y")
    zones.write.parquet(f"{tmp_path}/zones")
    spark.range(16 * 16).selectExpr("CAST(id / 16 AS INT) AS row_idx", "CAST(id % 16 AS INT) AS col_idx", "CAST(id AS DOUBLE) AS v").write.parquet(f"{tmp_path}/pixels")
    z = spark.read.parquet(f"{tmp_path}/zones").select("zone_id", G.box(F.col("x") - 8.5, F.col("y") - 8.5, F.col("x") + 8.5, F.col("y") + 8.5).alias("geometry"))
    grid = R.Grid(0.0, 0.0, 10.0, -10.0, 16, 16)
    assert T.zone_spans(z, grid, "zone_id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    met = T.zonal_pixels(z, spark.read.parquet(f"{tmp_path}/pixels"), grid, "zone_id", ["v"])
    joins = [line for line in met._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line and "Inner" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
    want = {(f"z{k}", r, p) for k in range(40) for r in range(16) for p in range(16)
            if abs(10 * p + 5 - k * 3 % 60) < 8.5 and abs(10 * r + 5 - k * 7 % 50) < 8.5}
    assert {(r.zone_id, r.row_idx, r.col_idx) for r in met.collect()} == want
