"""DuckDB text fragments shared by several oracles."""

from landwatch.functions import projection as P


def utm_sql(source: str, lon: str, lat: str, x: str, y: str, zone: str, out: str) -> str:
    """Common table expressions ending in ``out``: source.* with easting and northing (north)."""
    n = 2.0
    xi = " + ".join(["_xi"] + [f"{a!r}::DOUBLE * sin({n * j} * _xi) * cosh({n * j} * _eta)" for j, a in enumerate(P.ALPHA, 1)])
    eta = " + ".join(["_eta"] + [f"{a!r}::DOUBLE * cos({n * j} * _xi) * sinh({n * j} * _eta)" for j, a in enumerate(P.ALPHA, 1)])
    return f"""
{out}_1 AS (SELECT *, tan(radians({lat})) AS _tau, radians({lon} - ({zone} * 6 - 183)) AS _dl,
  sinh({P.E!r}::DOUBLE * atanh({P.E!r}::DOUBLE * sin(radians({lat})))) AS _sig FROM {source}),
{out}_2 AS (SELECT *, _tau * sqrt(1 + _sig * _sig) - _sig * sqrt(1 + _tau * _tau) AS _tp FROM {out}_1),
{out}_3 AS (SELECT *, atan2(_tp, cos(_dl)) AS _xi, asinh(sin(_dl) / sqrt(_tp * _tp + cos(_dl) * cos(_dl))) AS _eta FROM {out}_2),
{out} AS (SELECT * EXCLUDE (_tau, _dl, _sig, _tp, _xi, _eta),
  {P.FALSE_E!r}::DOUBLE + {P.RECT!r}::DOUBLE * ({eta}) AS {x}, {P.RECT!r}::DOUBLE * ({xi}) AS {y} FROM {out}_3)"""


# Additive points of a relation with the pair columns.
POINTS = """
CASE WHEN distance_meters < 100 THEN 28 WHEN distance_meters < 500 THEN 21 WHEN distance_meters < 1000 THEN 14
     WHEN distance_meters < 2500 THEN 7 ELSE 0 END AS distance_points,
CASE WHEN distance_meters < 100 THEN 'DISTANCE_LT_100M' WHEN distance_meters < 500 THEN 'DISTANCE_LT_500M'
     WHEN distance_meters < 1000 THEN 'DISTANCE_LT_1KM' WHEN distance_meters < 2500 THEN 'DISTANCE_LT_2.5KM'
     ELSE 'DISTANCE_FAR' END AS distance_code,
CASE WHEN ndvi_drop_mean <= -0.5::DOUBLE THEN 25 WHEN ndvi_drop_mean <= -0.4::DOUBLE THEN 20
     WHEN ndvi_drop_mean <= -0.3::DOUBLE THEN 15 WHEN ndvi_drop_mean <= -0.2::DOUBLE THEN 10 ELSE 0 END AS ndvi_points,
CASE WHEN ndvi_drop_mean <= -0.5::DOUBLE THEN 'NDVI_DROP_SEVERE' WHEN ndvi_drop_mean <= -0.4::DOUBLE THEN 'NDVI_DROP_STRONG'
     WHEN ndvi_drop_mean <= -0.3::DOUBLE THEN 'NDVI_DROP_MODERATE' WHEN ndvi_drop_mean <= -0.2::DOUBLE THEN 'NDVI_DROP_MILD'
     ELSE 'NDVI_DROP_MINIMAL' END AS ndvi_code,
CASE WHEN area_sq_meters >= 50000 THEN 15 WHEN area_sq_meters >= 25000 THEN 11 WHEN area_sq_meters >= 10000 THEN 8
     WHEN area_sq_meters >= 5000 THEN 4 ELSE 0 END AS area_points,
CASE WHEN area_sq_meters >= 50000 THEN 'LARGE_AREA_GT_50000M2' WHEN area_sq_meters >= 25000 THEN 'LARGE_AREA_GT_25000M2'
     WHEN area_sq_meters >= 10000 THEN 'AREA_GT_10000M2' WHEN area_sq_meters >= 5000 THEN 'AREA_GT_5000M2'
     ELSE 'AREA_SMALL' END AS area_code,
CASE WHEN slope_degree_mean >= 30 THEN 10 WHEN slope_degree_mean >= 20 THEN 7 WHEN slope_degree_mean >= 15 THEN 5
     WHEN slope_degree_mean >= 10 THEN 3 WHEN slope_degree_mean IS NOT NULL THEN 0 END AS base_points,
CASE WHEN slope_degree_mean >= 30 THEN 'SLOPE_GT_30DEG' WHEN slope_degree_mean >= 20 THEN 'SLOPE_GT_20DEG'
     WHEN slope_degree_mean >= 15 THEN 'SLOPE_GT_15DEG' WHEN slope_degree_mean >= 10 THEN 'SLOPE_GT_10DEG'
     WHEN slope_degree_mean IS NOT NULL THEN 'SLOPE_FLAT' END AS base_code,
CASE WHEN elevation_diff_m > 5 THEN 1.5::DOUBLE + least(1.0::DOUBLE, 1.0::DOUBLE * elevation_diff_m / 100)
     WHEN elevation_diff_m < -5
       THEN 0.9::DOUBLE - least(0.9::DOUBLE - 0.7::DOUBLE, (0.9::DOUBLE - 0.7::DOUBLE) * abs(elevation_diff_m) / 100)
     ELSE 1.0::DOUBLE END AS modifier,
CASE WHEN aspect_degrees IS NULL THEN NULL WHEN aspect_degrees >= 157.5 AND aspect_degrees < 202.5 THEN 5
     WHEN aspect_degrees >= 135 AND aspect_degrees < 225 THEN 4 WHEN aspect_degrees >= 112.5 AND aspect_degrees < 247.5 THEN 2
     WHEN (aspect_degrees >= 22.5 AND aspect_degrees < 67.5) OR (aspect_degrees >= 292.5 AND aspect_degrees < 337.5) THEN 1
     ELSE 0 END AS aspect_points,
CASE WHEN aspect_degrees IS NULL THEN NULL WHEN aspect_degrees >= 157.5 AND aspect_degrees < 202.5 THEN 'ASPECT_SOUTH'
     WHEN aspect_degrees >= 135 AND aspect_degrees < 157.5 THEN 'ASPECT_SE'
     WHEN aspect_degrees >= 202.5 AND aspect_degrees < 225 THEN 'ASPECT_SW'
     WHEN aspect_degrees >= 112.5 AND aspect_degrees < 135 THEN 'ASPECT_EAST'
     WHEN aspect_degrees >= 225 AND aspect_degrees < 247.5 THEN 'ASPECT_WEST'
     WHEN aspect_degrees >= 22.5 AND aspect_degrees < 67.5 THEN 'ASPECT_NE'
     WHEN aspect_degrees >= 292.5 AND aspect_degrees < 337.5 THEN 'ASPECT_NW'
     WHEN aspect_degrees >= 337.5 OR aspect_degrees < 22.5 THEN 'ASPECT_NORTH' ELSE 'ASPECT_OTHER' END AS aspect_code,
coalesce(CASE land_cover_class WHEN 'Forest' THEN 1.0::DOUBLE WHEN 'Residential' THEN 0.9::DOUBLE
  WHEN 'HerbaceousVegetation' THEN 0.85::DOUBLE WHEN 'River' THEN 0.8::DOUBLE WHEN 'PermanentCrop' THEN 0.75::DOUBLE
  WHEN 'Pasture' THEN 0.7::DOUBLE WHEN 'Industrial' THEN 0.5::DOUBLE WHEN 'SeaLake' THEN 0.4::DOUBLE
  WHEN 'AnnualCrop' THEN 0.3::DOUBLE WHEN 'Highway' THEN 0.25::DOUBLE END, 1.0::DOUBLE) AS cover_m,
CASE WHEN elevation_diff_m > 5 THEN 1.8::DOUBLE + 0.5::DOUBLE ELSE 1.8::DOUBLE END AS slide_m,
CASE criticality WHEN 0 THEN 0.5::DOUBLE WHEN 2 THEN 1.5::DOUBLE WHEN 3 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS crit_m
"""

# Relation chain from ``pairs`` to ``scored`` with risk_score and risk_level.
SCORE = f"""
pts AS (SELECT *, {POINTS} FROM pairs),
sl AS (SELECT *, CASE WHEN base_points IS NULL THEN NULL WHEN elevation_diff_m IS NULL THEN base_points
   ELSE least(20, CAST(trunc(base_points * modifier) AS INT)) END AS slope_points,
   CASE WHEN base_points IS NULL THEN NULL WHEN elevation_diff_m IS NULL THEN base_code
   WHEN elevation_diff_m > 5 THEN 'SLOPE_UPSLOPE' WHEN elevation_diff_m < -5 THEN 'SLOPE_DOWNSLOPE' ELSE 'SLOPE_LEVEL' END AS slope_code FROM pts),
s0 AS (SELECT *, distance_points + ndvi_points + area_points + coalesce(slope_points, 0) + coalesce(aspect_points, 0) AS t0 FROM sl),
s1 AS (SELECT *, CASE WHEN change_type = 'LandslideDebris' AND cover_m < 1 THEN t0 ELSE CAST(trunc(t0 * cover_m) AS INT) END AS t1 FROM s0),
s2 AS (SELECT *, CASE WHEN change_type = 'LandslideDebris' AND coalesce(slope_degree_mean, 0) >= 15
   THEN CAST(trunc(t1 * slide_m) AS INT) ELSE t1 END AS t2 FROM s1),
s3 AS (SELECT *, CAST(trunc(least(100.0::DOUBLE, t2 * crit_m)) AS INT) AS risk_score FROM s2),
scored AS (SELECT *, CASE WHEN risk_score BETWEEN 0 AND 24 THEN 'Low' WHEN risk_score BETWEEN 25 AND 49 THEN 'Medium'
   WHEN risk_score BETWEEN 50 AND 74 THEN 'High' WHEN risk_score BETWEEN 75 AND 100 THEN 'Critical' ELSE 'Unknown' END AS risk_level FROM s3)
"""

CHANGE_TYPE = """
CASE WHEN ndvi_drop_mean < -0.4::DOUBLE THEN CASE WHEN land_cover_class = 'Forest' THEN 'FireBurnScar'
       WHEN land_cover_class IN ('AnnualCrop', 'PermanentCrop') THEN 'AgriculturalChange' ELSE 'VegetationLoss' END
     WHEN ndvi_drop_mean < -0.2::DOUBLE THEN CASE WHEN land_cover_class IN ('AnnualCrop', 'PermanentCrop') THEN 'AgriculturalChange'
       WHEN land_cover_class IN ('HerbaceousVegetation', 'Pasture') THEN 'DroughtStress' ELSE 'VegetationLoss' END
     WHEN ndvi_drop_mean > 0.2::DOUBLE THEN 'VegetationGain' ELSE 'Unknown' END"""

# Changes with their final type: the landslide flag wins over the type by land cover.
TYPED = f"""typed AS (SELECT *, CASE WHEN is_landslide THEN 'LandslideDebris' ELSE {CHANGE_TYPE} END AS change_type FROM changes)"""

EVENT_PAIRS = f"""{TYPED},
pairs AS (SELECT e.risk_event_id, e.distance_meters, t.*, a.criticality, a.asset_type,
  t.elevation_m - a.asset_elevation_m AS elevation_diff_m
  FROM risk_events e JOIN typed t ON e.change_id = t.change_id JOIN assets a ON e.asset_id = a.asset_id)"""

ASSET_TYPE = """CASE {0} WHEN 0 THEN 'TransmissionLine' WHEN 1 THEN 'Substation' WHEN 2 THEN 'GasPipeline' WHEN 3 THEN 'Building'
 WHEN 4 THEN 'Road' WHEN 5 THEN 'FireStation' WHEN 6 THEN 'Hospital' WHEN 7 THEN 'School' WHEN 8 THEN 'WaterInfrastructure'
 WHEN 99 THEN 'Other' END"""
LEVEL_CODE = """CASE WHEN {0} >= 75 THEN 3 WHEN {0} >= 50 THEN 2 WHEN {0} >= 25 THEN 1 ELSE 0 END"""
LEVEL_NAME = """CASE {0} WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' WHEN 3 THEN 'Critical' END"""
STATUS = """CASE {0} WHEN 0 THEN 'Pending' WHEN 1 THEN 'FetchingImagery' WHEN 2 THEN 'CalculatingNdvi' WHEN 3 THEN 'DetectingChanges'
 WHEN 4 THEN 'ScoringRisk' WHEN 5 THEN 'Completed' WHEN 6 THEN 'Failed' END"""
