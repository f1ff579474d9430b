import numpy as np
import pytest
from pyspark.sql import functions as F

from landwatch.operators import proximity as X
from landwatch.operators import reach as R
from landwatch.operators import scoring as S
from landwatch.schema import GEOMETRY_DDL
from tests.test_proximity import box


def tables(spark, n=60, m=90):
    """Boxes and assets of all kinds around two borders of cells and one of UTM zones, with repeats, nulls and NaN."""
    rng = np.random.default_rng(3)
    place = lambda: (float(rng.uniform(-120.012, -119.99)), float(rng.uniform(39.73, 39.75)))
    pick = lambda values: values[int(rng.integers(len(values)))]
    changes, assets = [], []
    for k in range(n):
        row = (pick(["p", "p", "q", None]), box(*place(), float(rng.uniform(0.0001, 0.002))), pick([None, -0.6, -0.35, 0.1]), pick([None, 3000.0, 20000.0]),
               pick([None, 4.0, 12.0, 16.0, 35.0]), pick([None, 10.0, 180.0, 340.0]), pick([None, "Forest", "Highway", "Moor"]), pick(["LandslideDebris", "Other", None]),
               pick([None, float("nan"), *rng.uniform(200, 300, 8).round(1).tolist()]))
        changes += [(f"c{k}", *row)] + [(f"c{k + n}" if k % 2 else f"c{k}", *row)] * (k % 5 == 0)
    for k in range(m):
        x, y = place()
        shape = [("Point", [[[(x, y)]]]), ("Point", [[[(x, y)]]]), ("LineString", [[[(x, y), (x + 0.02, y + 0.005)]]]), box(x, y, 0.002)][k % 4]
        row = (pick(["p", "p", "q", None]), 3, shape, pick([0, 1, 2, 3, None]), pick([None, float("nan"), *rng.uniform(200, 300, 8).round(1).tolist()]))
        assets += [(f"a{k}", *row)] + [(None if k % 2 else f"a{k + m}", *row)] * (k % 3 == 0)
    ch = spark.createDataFrame(changes, f"change_id string, aoi_id string, geometry {GEOMETRY_DDL}, ndvi_drop_mean double, area_sq_meters double, slope_degree_mean double, "
                                        "aspect_degrees double, land_cover_class string, change_type string, change_elevation_m double")
    return ch, spark.createDataFrame(assets, f"asset_id string, aoi_id string, asset_type int, geometry {GEOMETRY_DDL}, criticality int, asset_elevation_m double")


@pytest.mark.parametrize("rows", [50_000, 7])
def test_nearest_in_reach_equals_the_listed_pairs(spark, rows):
    ch, a = tables(spark)
    plain = lambda df: sorted((str(r.change_id), r.asset_count, round(r.nearest_m, 6), str(r.nearest_asset_id)) for r in df.collect())
    want = plain(X.matched_changes(X.distance_join(ch.select("change_id", "aoi_id", "geometry"), a, 500.0, within=["aoi_id"])))
    assert plain(R.nearest_in_reach(ch, a, 500.0, within=["aoi_id"], cell_rows=rows)) == want and len(want) > 20


@pytest.mark.parametrize("rows", [50_000, 7])
def test_scores_of_classes_equal_those_of_pairs(spark, rows):
    ch, a = tables(spark)
    total = lambda df, n: sorted((r.aoi_id, r.risk_score, r.risk_level, r.n) for r in df.groupBy("aoi_id", "risk_score", "risk_level").agg(n.alias("n")).collect())
    want = total(S.score_pairs(S.with_criticality_name(X.directional(X.distance_join(ch, a, 500.0, within=["aoi_id"])))), F.count("*"))
    height = lambda name, most: F.when(F.isnan(name), F.lit(most)).otherwise(F.col(name)).alias("_height")
    traits = ["aoi_id", "area_sq_meters", "ndvi_drop_mean", "slope_degree_mean", "aspect_degrees", "land_cover_class", "change_type"]
    classes = R.pair_classes(S.score_classes(ch).withColumn("_height", height("change_elevation_m", 1e300)), a.withColumn("_height", height("asset_elevation_m", -1e300)),
                             500.0, [100.0, 500.0, 1000.0], S.rise_steps(), traits, ["criticality"], within=["aoi_id"], cell_rows=rows)
    assert total(S.score_pairs(S.with_criticality_name(classes)), F.sum("pairs")) == want and len(want) > 20


def test_dense_places_measure_few_pairs(spark, monkeypatch):
    """Counting 4 000 assets around 400 changes measures far fewer than their 1.6 million pairs; the old form listed them all."""
    rng = np.random.default_rng(4)
    side = lambda n, h: {"flat": R.K._flat(g := R._points(*rng.uniform(0, 1000, (2, n))), g.x, g.y), "height": np.zeros(n), "group": np.zeros(n, np.int64), "weight": np.ones(n, np.int64),
                         "polygon": np.zeros(n, bool), "first": np.ones((1, 2), bool), "known": np.ones(1, bool), "by": np.zeros(1, np.int64), "kind": np.zeros(1, np.int64)}
    met, measured = R.Meeting(side(400, 0), side(4000, 0)), []
    real = R.K.pair_distance
    monkeypatch.setattr(R.K, "pair_distance", lambda a, p, b, q: measured.append(len(p)) or real(a, p, b, q))
    held, kinds = met.tally(300.0, np.zeros(0), lambda rise, kind: np.zeros(len(rise), np.int64))
    i, j, d = met.nearest(300.0)
    assert sum(measured) < 400 * 4000 / 4
    a, b = (np.column_stack([R.K.FlatRagged(f).x, R.K.FlatRagged(f).y]) for f in (met.flats[0], met.flats[1]))
    far = np.hypot(*(a[:, None] - b[None]).transpose(2, 0, 1))
    want = np.empty(400)
    want[met.a.order] = (far <= 300.0).sum(axis=1)
    assert (held.sum(axis=1) == want).all()
    best = np.full(400, np.inf)
    np.fmin.at(best, i, d)
    least = np.empty(400)
    least[met.a.order] = far.min(axis=1)
    assert np.allclose(best, least)


@pytest.mark.parametrize("rows", [50_000, 7])
def test_wide_changes_meet_each_asset_once(spark, rows):
    """Changes of several cells, one beyond the antimeridian, beside narrow ones; assets of several cells and on borders of cells."""
    size = 360.0 / int(360.0 / (4 * 500.0 * X.MARGIN / X.SHORTEST_DEGREE_M))
    x, y = size * round(-121.6 / size), size * round(39.7 / size)
    ch = spark.createDataFrame([(f"c{k}", "p", g) for k, g in enumerate([box(x, y, 0.0003), box(x + 0.001, y, 0.03), box(x, y + 0.012, 0.011), box(179.9995, 10.0, 0.0004), box(x, y, 0.05)])],
                               f"change_id string, aoi_id string, geometry {GEOMETRY_DDL}")
    points = [("Point", [[[(x + u, y + v)]]]) for u in (-0.055, -0.02, -0.004, 0.0, 0.004, 0.02, 0.055) for v in (-0.055, -0.004, 0.0, 0.02)]
    shapes = [*points, ("LineString", [[[(x - 0.1, y), (x + 0.1, y + 0.01)]]]), ("Point", [[[(-179.9995, 10.001)]]]), box(x + 0.03, y, 0.02)]
    a = spark.createDataFrame([(f"a{k}", "p", 3, g) for k, g in enumerate(shapes)], f"asset_id string, aoi_id string, asset_type int, geometry {GEOMETRY_DDL}")
    plain = lambda df: sorted((r.change_id, r.asset_count, round(r.nearest_m, 6), r.nearest_asset_id) for r in df.collect())
    want = plain(X.matched_changes(X.distance_join(ch, a, 500.0, within=["aoi_id"])))
    assert plain(R.nearest_in_reach(ch, a, 500.0, within=["aoi_id"], cell_rows=rows)) == want and len(want) == 5


def test_a_narrow_change_is_shuffled_once(spark, monkeypatch):
    """Narrow boxes stand in one group each; before, in four and more, and were shuffled again to be salted."""
    real, seen = R.salted_sides, []
    monkeypatch.setattr(R, "salted_sides", lambda left, right, *rest: seen.append(left) or real(left, right, *rest))
    ch = spark.createDataFrame([(f"c{k}", "p", box(-121.6 + 0.0011 * k, 39.7 + 0.0017 * k, 0.0008), None, 0) for k in range(60)],
                               f"change_id string, aoi_id string, geometry {GEOMETRY_DDL}, _height double, _kind long")
    a = spark.createDataFrame([("a", "p", 3, ("Point", [[[(-121.6, 39.7)]]]), None, 1)], f"asset_id string, aoi_id string, asset_type int, geometry {GEOMETRY_DDL}, _height double, criticality int")
    classes = R.pair_classes(ch, a, 500.0, [100.0], S.rise_steps(), ["aoi_id"], ["criticality"], within=["aoi_id"])
    assert seen[0].count() == 60
    joins = [line for line in classes._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line]
    assert joins and not any("SortMergeJoin" in line and "LeftOuter" in line for line in joins)
