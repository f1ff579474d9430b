import pytest
from pyspark.sql import functions as F

from landwatch.config import DEFAULT_SCORING, scoring_config
from landwatch.operators import scoring as S

COLS = ("distance_meters double, ndvi_drop_mean double, area_sq_meters double, slope_degree_mean double, aspect_degrees double, "
        "land_cover_class string, change_type string, criticality int, criticality_name string, elevation_diff_m double")
BASE = dict(distance_meters=250.0, ndvi_drop_mean=-0.35, area_sq_meters=15000.0, slope_degree_mean=None, aspect_degrees=None,
            land_cover_class=None, change_type="VegetationLoss", criticality=1, criticality_name="Medium", elevation_diff_m=None)


def score(spark, overrides=None, **changes):
    row = {**BASE, **changes}
    df = spark.createDataFrame([tuple(row[k.split()[0]] for k in COLS.split(", "))], COLS)
    r = S.score_pairs(df, overrides).collect()[0]
    return r.risk_score, r.risk_level, {f.name: f for f in r.factors}, [f.name for f in r.factors]


def column(spark, values, build):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    p, code = build(F.col("v"), scoring_config())
    return [(r.p, r.code) for r in df.select(p.alias("p"), code.alias("code")).collect()]


def test_distance_steps_are_strict(spark):
    got = column(spark, [0, 99.9, 100, 499.9, 500, 999.9, 1000, 2499.9, 2500, 9000], S.distance_points)
    assert [p for p, _ in got] == [28, 28, 21, 21, 14, 14, 7, 7, 0, 0]
    assert got[0][1] == "DISTANCE_LT_100M" and got[7][1] == "DISTANCE_LT_2.5KM" and got[8][1] == "DISTANCE_FAR"


def test_ndvi_area_and_slope_steps_include_their_bound(spark):
    assert [p for p, _ in column(spark, [-0.6, -0.5, -0.49, -0.4, -0.3, -0.2, -0.19, 0.1], S.ndvi_points)] == [25, 25, 20, 20, 15, 10, 0, 0]
    assert [p for p, _ in column(spark, [50000, 49999, 25000, 10000, 5000, 4999], S.area_points)] == [15, 11, 11, 8, 4, 0]
    assert [p for p, _ in column(spark, [45, 30, 29.9, 20, 15, 10, 9.9, 0], S.slope_points)] == [10, 10, 7, 7, 5, 3, 0, 0]


def test_aspect_ranges_leave_due_east_and_west_open(spark):
    got = dict(zip([0, 22.5, 90, 112.5, 135, 180, 202.5, 225, 270, 300, 340, 360, -180],
                   column(spark, [0, 22.5, 90, 112.5, 135, 180, 202.5, 225, 270, 300, 340, 360, -180], S.aspect_points)))
    assert {k: v[0] for k, v in got.items()} == {0: 0, 22.5: 1, 90: 0, 112.5: 2, 135: 4, 180: 5, 202.5: 4, 225: 2, 270: 0, 300: 1, 340: 0, 360: 0, -180: 5}
    assert got[90][1] == "ASPECT_OTHER" and got[0][1] == "ASPECT_NORTH" and got[360][1] == "ASPECT_NORTH"


def test_direction_raises_and_lowers_slope(spark):
    cfg = scoring_config()
    df = spark.createDataFrame([(35.0, d) for d in (None, 5.0, 6.0, 50.0, 200.0, -5.0, -50.0, -300.0)], "s double, d double")
    p, code = S.directional_slope_points(F.col("s"), F.col("d"), cfg)
    got = [(r.p, r.k) for r in df.select(p.alias("p"), code.alias("k")).collect()]
    assert got == [(10, "SLOPE_GT_30DEG"), (10, "SLOPE_LEVEL"), (15, "SLOPE_UPSLOPE"), (20, "SLOPE_UPSLOPE"), (20, "SLOPE_UPSLOPE"),
                   (10, "SLOPE_LEVEL"), (8, "SLOPE_DOWNSLOPE"), (7, "SLOPE_DOWNSLOPE")]


def test_compass(spark):
    df = spark.createDataFrame([(float(a),) for a in (0, 22.4, 22.5, 90, 180, 247.5, 300, 337.5, 360)], "a double")
    assert [r[0] for r in df.select(S.compass(F.col("a"))).collect()] == ["N", "N", "NE", "E", "S", "W", "NW", "N", "N"]


def test_plain_score_and_factor_order(spark):
    total, level, f, order = score(spark)
    assert (total, level) == (21 + 15 + 8, "Medium")
    assert order == ["Distance", "NDVI Drop", "Area", "Criticality"]
    assert f["Distance"].details == "Distance: 250m" and f["NDVI Drop"].details == "NDVI drop: -0.350"
    assert f["Area"].details == "Area: 15,000 m²" and f["Criticality"].details == "Multiplier: 1.0x for Medium criticality"


def test_all_factors_keep_their_order(spark):
    total, level, _, order = score(spark, distance_meters=50.0, ndvi_drop_mean=-0.6, area_sq_meters=60000.0, slope_degree_mean=35.0, aspect_degrees=180.0,
                                   land_cover_class="Forest", change_type="LandslideDebris", criticality=3, criticality_name="Critical", elevation_diff_m=150.0)
    assert order == ["Distance", "NDVI Drop", "Area", "Slope + Direction", "Aspect", "Land Cover", "Landslide Detection", "Criticality"]
    assert (total, level) == (100, "Critical")


def test_truncation_happens_after_every_product(spark):
    # 44 points on pasture: int(44 * 0.7) = 30, then int(30 * 1.5) = 45.
    total, _, f, _ = score(spark, land_cover_class="Pasture", criticality=2, criticality_name="High")
    assert total == 45 and f["Land Cover"].points == 30 - 44 and f["Criticality"].points == 15
    assert f["Land Cover"].reason_code == "LANDCOVER_PASTURE"


def test_double_products_truncate_like_doubles(spark):
    # 90 * 0.7 is just under 63 in double precision.
    total, *_ = score(spark, distance_meters=10.0, ndvi_drop_mean=-0.9, area_sq_meters=60000.0, slope_degree_mean=30.0, aspect_degrees=50.0,
                      elevation_diff_m=90.0, land_cover_class="Pasture")
    assert total == int((28 + 25 + 15 + 20 + 1) * 0.7)


def test_landslides(spark):
    skip = score(spark, change_type="LandslideDebris", land_cover_class="AnnualCrop", slope_degree_mean=20.0)
    assert skip[2]["Land Cover"].reason_code == "LANDCOVER_ANNUALCROP_SKIP" and skip[2]["Land Cover"].points == 0
    assert skip[0] == int((44 + 7) * 1.8) and skip[2]["Landslide Detection"].reason_code == "LANDSLIDE_DETECTED"
    flat = score(spark, change_type="LandslideDebris", slope_degree_mean=14.9)
    assert flat[2]["Landslide Detection"].reason_code == "LANDSLIDE_LOW_SLOPE" and flat[2]["Landslide Detection"].points == 0
    assert "14.9° < 15° threshold" in flat[2]["Landslide Detection"].details
    none = score(spark, change_type="LandslideDebris", slope_degree_mean=None)
    assert none[2]["Landslide Detection"].reason_code == "LANDSLIDE_LOW_SLOPE"
    up = score(spark, change_type="LandslideDebris", slope_degree_mean=20.0, elevation_diff_m=6.0)
    assert up[2]["Landslide Detection"].reason_code == "LANDSLIDE_UPSLOPE" and "(multiplier: 2.30x)" in up[2]["Landslide Detection"].details


@pytest.mark.parametrize("code,name,expected", [(0, "Low", 22), (1, "Medium", 44), (2, "High", 66), (3, "Critical", 88), (7, "Odd", 44)])
def test_criticality(spark, code, name, expected):
    assert score(spark, criticality=code, criticality_name=name)[0] == expected


def test_own_thresholds_do_not_leak(spark):
    own = {"scoring_factors": {"distance": {"max_points": 99, "thresholds": [{"distance_m": 1000, "points": 50, "reason_code": "X"}]}, "nothing": {}},
           "risk_levels": [{"name": "Any", "min_score": 0, "max_score": 60}]}
    total, level, f, _ = score(spark, own)
    assert total == 50 + 15 + 8 and level == "Unknown" and f["Distance"].max_points == 99
    assert DEFAULT_SCORING["distance"]["max_points"] == 28 and score(spark)[0] == 44
