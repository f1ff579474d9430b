import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from landwatch.functions import geometry as G
from landwatch.functions import kernels as K
from landwatch.functions import projection as P

c = F.col


def test_utm_known_positions(spark):
    df = spark.createDataFrame([(3.0, 45.0), (-79.387139, 43.642567), (0.0, -0.0), (179.9, -60.0)], "lon double, lat double")
    r = P.add_utm(df, "lon", "lat").withColumns({"z": P.utm_zone(c("lon")), "epsg": P.utm_epsg(c("lon"), c("lat"))}).collect()
    assert (r[0].x, r[0].z, r[0].epsg) == (500000.0, 31, 32631) and abs(r[0].y - 4982950.400) < 1e-3
    assert abs(r[1].x - 630084.3) < 0.1 and abs(r[1].y - 4833438.6) < 0.1
    assert r[3].z == 60 and r[3].epsg == 32760 and r[3].y > 3e6


def test_utm_there_and_back(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(rng.uniform(-179, 179, 50), rng.uniform(-79, 83, 50))], "lon double, lat double")
    d = P.add_utm(df, "lon", "lat").withColumns({"z": P.utm_zone(c("lon")), "s": c("lat") < 0})
    for r in P.add_lonlat(d, "x", "y", "z", "s", "lon2", "lat2").collect():
        assert abs(r.lon - r.lon2) < 1e-9 and abs(r.lat - r.lat2) < 1e-9
    x, y = K.utm_xy(np.array([-121.6]), np.array([39.75]), np.array([10]), np.array([False]))
    one = P.add_utm(spark.createDataFrame([(-121.6, 39.75)], "lon double, lat double"), "lon", "lat").collect()[0]
    assert abs(one.x - x[0]) < 1e-6 and abs(one.y - y[0]) < 1e-6


def test_zone_clamp_and_truncation(spark):
    df = spark.createDataFrame([(-200.0,), (-180.0,), (180.0,), (-183.0,)], "lon double")
    assert [r[0] for r in df.select(P.utm_zone(c("lon"))).collect()] == [1, 1, 60, 1]


def ragged(geoms):
    xy = pa.struct([("x", pa.float64()), ("y", pa.float64())])
    return pa.array([[[[{"x": x, "y": y} for x, y in ring] for ring in part] for part in g] for g in geoms], pa.list_(pa.list_(pa.list_(xy))))


SQUARE = [[[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]]]
HOLED = [[[(0, 0), (9, 0), (9, 9), (0, 9), (0, 0)], [(3, 3), (6, 3), (6, 6), (3, 6), (3, 3)]]]
LINE = [[[(6, 0), (6, 10)]]]
POINT = [[[(7.0, 8.0)]]]


def dist(a, a_poly, b, b_poly):
    return K.pair_distance(K.Ragged(ragged([a])), np.array([a_poly]), K.Ragged(ragged([b])), np.array([b_poly]))[0]


def test_distances():
    assert dist(SQUARE, True, LINE, False) == 2.0
    assert dist(LINE, False, SQUARE, True) == 2.0
    assert dist(SQUARE, True, POINT, False) == 5.0
    assert dist(SQUARE, True, [[[(1.0, 1.0)]]], False) == 0.0
    assert dist(HOLED, True, [[[(4.5, 4.5)]]], False) == 1.5, "a hole is outside"
    assert dist(HOLED, True, [[[(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]]], True) == 0.0, "polygon inside polygon"
    assert dist([[[(0, 0), (10, 10)]]], False, [[[(0, 10), (10, 0)]]], False) == 0.0, "crossing lines"
    assert dist(SQUARE, True, [[[(20.0, 0.0)]], [[(2.0, 2.0)]]], False) == 0.0, "second point of a multi-point"
    assert dist([[[(4, 0), (4, 4)]]], False, SQUARE, True) == 0.0, "touching"


def test_distance_against_dense_sampling():
    rng = np.random.default_rng(3)
    for _ in range(30):
        a, b = rng.uniform(0, 10, (3, 2)), rng.uniform(0, 10, (4, 2))
        walk = lambda p: np.concatenate([p[i] + np.linspace(0, 1, 400)[:, None] * (p[i + 1] - p[i]) for i in range(len(p) - 1)])
        near = np.sqrt(((walk(a)[:, None] - walk(b)[None]) ** 2).sum(2)).min()
        got = dist([[[tuple(v) for v in a]]], False, [[[tuple(v) for v in b]]], False)
        assert got <= near + 1e-9 and near - got < 0.06


def test_centroids_areas_and_points_inside(spark):
    rows = [("Polygon", SQUARE), ("Polygon", HOLED), ("LineString", [[[(0, 0), (0, 4), (2, 4)]]]), ("Point", POINT), ("MultiPoint", [[[(0, 0)]], [[(2, 4)]]]),
            ("MultiPolygon", [[[(0, 0), (0, 1), (1, 1), (1, 0), (0, 0)]], [[(10, 0), (12, 0), (12, 2), (10, 2), (10, 0)]]])]
    data = [((k, [[[(float(x), float(y)) for x, y in r] for r in p] for p in g]),) for k, g in rows]
    from landwatch.schema import GEOMETRY_DDL
    df = spark.createDataFrame(data, f"g {GEOMETRY_DDL}")
    r = df.select(G.centroid(c("g")).alias("m"), G.area(c("g")).alias("a"), G.largest_part(c("g")).alias("big"), K.contains_point("g.parts", F.lit(4.5), F.lit(4.4)).alias("i")).collect()
    assert [x.a for x in r] == [16.0, 72.0, 0.0, 0.0, 0.0, 5.0]
    assert (r[0].m.x, r[0].m.y) == (2.0, 2.0) and abs(r[1].m.x - 4.5) < 1e-12
    assert abs(r[2].m.x - 1 / 3) < 1e-12 and abs(r[2].m.y - 8 / 3) < 1e-12
    assert (r[3].m.x, r[4].m.y) == (7.0, 2.0) and abs(r[5].m.x - (0.5 + 4 * 11) / 5) < 1e-12
    assert r[5].big.type == "Polygon" and r[5].big.parts[0][0][0].x == 10.0
    assert [x.i for x in r[:2]] == [False, False]


def test_geojson_round_trip_and_rejects(spark):
    texts = ['{"type":"Point","coordinates":[1.5,2.0]}', '{"type":"MultiLineString","coordinates":[[[0.0,0.0],[1.0,1.0]],[[2.0,2.0],[3.0,3.0]]]}',
             '{"type":"Polygon","coordinates":[[[0.0,0.0],[1.0,0.0],[1.0,1.0],[0.0,0.0]]]}', '{"type":"MultiPoint","coordinates":[[1.0,2.0],[3.0,4.0]]}']
    bad = ['{"type":"Point","coordinates":[]}', '{"type":"Circle","coordinates":[1,2]}', "nothing", '{"type":"LineString","coordinates":[[1,2],["a","b"]]}']
    df = spark.createDataFrame([(x,) for x in texts + bad], "t string")
    got = [r[0] for r in df.select(G.to_geojson(G.from_geojson(c("t")))).collect()]
    assert got == texts + [None] * 4


def test_box_tests(spark):
    from landwatch.schema import GEOMETRY_DDL
    rows = [("LineString", [[[(-1.0, -1.0), (5.0, 5.0)]]], True), ("LineString", [[[(-1.0, 3.0), (3.0, 7.0)]]], False), ("Polygon", [[[(-9.0, -9.0), (9.0, -9.0), (9.0, 9.0), (-9.0, 9.0), (-9.0, -9.0)]]], True),
            ("Point", [[[(0.5, 2.0)]]], True), ("Point", [[[(0.5, 2.01)]]], False), ("LineString", [[[(1.0, -5.0), (1.0, 5.0)]]], True)]
    df = spark.createDataFrame([((k, g), w) for k, g, w in rows], f"g {GEOMETRY_DDL}, want boolean")
    got = df.select(K.meets_box("g.type", "g.parts", F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(2.0)).alias("hit"), "want").collect()
    assert all(r.hit == r.want for r in got)


def test_mercator_and_box_builders(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],), ([1.0, 2.0],)], "b array<double>")
    r = df.select(G.box_from_array(c("b")).alias("g")).collect()
    assert len(r[0].g.parts[0][0]) == 5 and r[1].g is None
    m = spark.range(1).select(P.mercator_lon(P.mercator_x(F.lit(-121.6))).alias("x"), P.mercator_lat(P.mercator_y(F.lit(39.75))).alias("y")).collect()[0]
    assert math.isclose(m.x, -121.6, abs_tol=1e-12) and math.isclose(m.y, 39.75, abs_tol=1e-12)
