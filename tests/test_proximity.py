import numpy as np
from pyspark.sql import functions as F

from landwatch.functions import kernels as K
from landwatch.operators import proximity as X
from landwatch.operators.ranking import split_rank
from landwatch.schema import GEOMETRY_DDL
from tests.test_geometry import ragged


def box(x, y, h):
    return ("Polygon", [[[(x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h), (x - h, y - h)]]])


def frames(spark, changes, assets):
    ch = spark.createDataFrame([(f"c{i}", g) for i, g in enumerate(changes)], f"change_id string, geometry {GEOMETRY_DDL}")
    a = spark.createDataFrame([(f"a{i}", t, g) for i, (t, g) in enumerate(assets)], f"asset_id string, asset_type int, geometry {GEOMETRY_DDL}")
    return ch, a


def nested_loop(changes, assets, d):
    out = {}
    for i, (_, cg) in enumerate(changes):
        cen = np.mean(np.array(cg[0][0][:4]), axis=0)
        zone = int((cen[0] + 180) / 6) + 1
        move = lambda g: [[[tuple(float(v[0]) for v in K.utm_xy(np.array([x]), np.array([y]), np.array([zone]), np.array([cen[1] < 0]))) for x, y in r] for r in p] for p in g]
        for j, (t, (kind, ag)) in enumerate(assets):
            v = K.pair_distance(K.Ragged(ragged([move(cg)])), np.array([True]), K.Ragged(ragged([move(ag)])), np.array([kind.endswith("Polygon")]))[0]
            if v <= d:
                out[(f"c{i}", f"a{j}")] = v
    return out


def test_grid_join_equals_nested_loop(spark):
    rng = np.random.default_rng(5)
    place = lambda: (float(rng.uniform(-121.62, -121.58)), float(rng.uniform(39.73, 39.77)))
    changes = [box(*place(), float(rng.uniform(0.0002, 0.002))) for _ in range(25)] + [box(-120.0005, 10.0, 0.001), box(20.0, -35.0, 0.001)]
    assets = []
    for k in range(60):
        x, y = place()
        if k % 3 == 0:
            assets.append((3, ("Point", [[[(x, y)]]])))
        elif k % 3 == 1:
            assets.append((4, ("LineString", [[[(x, y), (x + 0.02, y + 0.005), (x + 0.03, y - 0.01)]]])))
        else:
            assets.append((3, box(x, y, 0.003)))
    assets += [(3, ("Point", [[[(-119.9985, 10.0)]]])), (3, ("Point", [[[(20.003, -35.002)]]]))]
    want = nested_loop(changes, assets, 600.0)
    for rows in (50_000, 2):
        got = {(r.change_id, r.asset_id): r.distance_meters for r in X.distance_join(*frames(spark, changes, assets), 600.0, cell_rows=rows).collect()}
        assert got.keys() == want.keys() and len(got) > 100
        assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_pairs_come_once_and_reach_over_the_date_line(spark):
    ch, a = frames(spark, [box(179.9995, 0.5, 0.0001)], [(3, ("Point", [[[(-179.9995, 0.5)]]])), (4, ("LineString", [[[(179.9, 0.5), (179.9999, 0.5)]]]))])
    got = X.distance_join(ch, a, 200.0).collect()
    assert sorted(r.asset_id for r in got) == ["a0", "a1"] and 80 < [r for r in got if r.asset_id == "a0"][0].distance_meters < 120


def test_unfit_assets_and_changes_are_left_out(spark):
    here = [[[(10.0, 10.0)]]]
    ch, a = frames(spark, [box(10.0, 10.0, 0.001), box(620000.0, 4400000.0, 50.0)],
                   [(0, ("LineString", [[[(10.0, 10.0), (10.1, 10.0)]]])), (0, ("Point", here)), (4, ("Point", [[[(200.0, 10.0)]]])), (4, None), (4, ("Point", here))])
    assert sorted(r.asset_id for r in X.distance_join(ch, a, 100.0).collect()) == ["a1", "a4"]
    good, bad = X.split_changes(ch)
    assert [r.change_id for r in bad.collect()] == ["c1"] and good.count() == 1


def test_distance_limit_is_inclusive_and_zero_inside(spark):
    ch, a = frames(spark, [box(10.0, 10.0, 0.001)], [(3, ("Point", [[[(10.0, 10.0)]]]))])
    assert X.distance_join(ch, a, 0.0).collect()[0].distance_meters == 0.0


def test_split_rank_equals_row_number(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k), float(d), f"t{i}") for i, (k, d) in enumerate(zip(rng.integers(0, 3, 300), np.round(rng.uniform(0, 50, 300))))]
    df = spark.createDataFrame(rows, "k int, d double, t string")
    got = {(r.k, r.t): r["rank"] for r in split_rank(df, ["k"], "d", ["t"], parts=7).collect()}
    for k in range(3):
        order = sorted((d, t) for kk, d, t in rows if kk == k)
        assert [got[(k, t)] for _, t in order] == list(range(1, len(order) + 1))


def test_slope_toward_is_zero_within_a_metre(spark):
    df = spark.createDataFrame([(10.0, 10.0, 10.000001, 10.0, 50.0, 20.0), (10.0, 10.0, 10.01, 10.0, 50.0, 20.0), (10.0, 10.0, 10.01, 10.0, None, 20.0)],
                               "a double, b double, x double, y double, e1 double, e2 double")
    r = [q[0] for q in X.slope_toward(df, "a", "b", "x", "y", "e1", "e2").select("slope_toward_asset_deg").collect()]
    assert r[0] == 0.0 and abs(r[1] - np.degrees(np.arctan2(30, 1096))) < 0.01 and r[2] is None


def test_salted_join_gives_every_pair_once(spark):
    from landwatch.operators.skew import salted_join
    a = spark.createDataFrame([(i % 3 if i < 20 else 0, i) for i in range(60)], "k int, a int")
    b = spark.createDataFrame([(i % 4 if i < 20 else 0, i) for i in range(50)], "k int, b int")
    want = sorted((r.k, r.a, r.b) for r in a.join(b, "k").collect())
    for ids in (("a", "b"), ("a", None), (None, "b"), (None, None)):
        assert sorted((r.k, r.a, r.b) for r in salted_join(a, b, ["k"], *ids, rows=7).collect()) == want
