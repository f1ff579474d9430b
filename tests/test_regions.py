from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from landwatch.functions import geometry as G
from landwatch.operators import regions as R
from landwatch.operators.raster import Grid


def flood(mask):
    """Smallest row * width + col of each pixel's region, by breadth-first search."""
    h, w = mask.shape
    out = {}
    for r in range(h):
        for k in range(w):
            if mask[r, k] and (r, k) not in out:
                todo = deque([(r, k)])
                out[(r, k)] = r * w + k
                while todo:
                    a, b = todo.popleft()
                    for x, y in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                        if 0 <= x < h and 0 <= y < w and mask[x, y] and (x, y) not in out:
                            out[(x, y)] = r * w + k
                            todo.append((x, y))
    return out


def spiral(n):
    m = np.zeros((n, n), int)
    r0, r1, c0, c1 = 0, n - 1, 0, n - 1
    while r0 <= r1 and c0 <= c1:
        m[r0, c0:c1 + 1] = 1
        m[r0:r1 + 1, c1] = 1
        m[r1, c0:c1 + 1] = 1
        m[r0 + 2:r1 + 1, c0] = 1
        if r0 + 2 <= r1:
            m[r0 + 2, c0:c0 + 2] = 1
        r0, r1, c0, c1 = r0 + 2, r1 - 2, c0 + 2, c1 - 2
    return m


def pixels(spark, mask):
    return spark.createDataFrame([("s", int(r), int(k)) for r, k in zip(*np.nonzero(mask))], "scene string, row_idx int, col_idx int")


@pytest.mark.parametrize("mask", [(np.random.default_rng(7).random((23, 31)) < 0.58).astype(int), spiral(21)], ids=["noise", "spiral"])
def test_labels_equal_flood_fill_across_tiles(spark, mask):
    w = mask.shape[1]
    got = {(r.row_idx, r.col_idx): r.component_id for r in R.label_regions(pixels(spark, mask), ["scene"], tile=4, width=w).collect()}
    assert got == flood(mask)


def rebuild(geoms, shape):
    """Pixels inside the polygons by even-odd count of edges to the left."""
    out = np.zeros(shape, int)
    for g in geoms:
        for part in g.parts:
            for ring in part:
                for p, q in zip(ring[:-1], ring[1:]):
                    if p.x == q.x:
                        lo, hi = sorted((int(p.y), int(q.y)))
                        out[lo:hi, int(p.x):] += 1
    return out % 2


def polygons(spark, mask, tile):
    labelled = R.label_regions(pixels(spark, mask), ["scene"], tile=5, width=mask.shape[1])
    return R.region_polygons(labelled, ["scene"], None, tile=tile).withColumn("area", G.area(F.col("geometry"))).collect()


@pytest.mark.parametrize("mask", [(np.random.default_rng(9).random((18, 20)) < 0.6).astype(int), spiral(21), np.ones((9, 9), int),
                                  np.pad(np.ones((7, 9), int) - np.pad(np.ones((3, 3), int), ((2, 2), (3, 3))), 2)], ids=["noise", "spiral", "full", "hole"])
def test_one_polygon_a_region_whatever_the_tiles(spark, mask):
    found = {tile: polygons(spark, mask, tile) for tile in (3, 64)}
    for rows in found.values():
        assert len(rows) == len({r.component_id for r in rows}) == len(set(flood(mask).values()))
        assert sum(r.pixels for r in rows) == mask.sum() and all(r.area == r.pixels for r in rows)
        assert (rebuild([r.geometry for r in rows], mask.shape) == mask).all()
        assert all(r.geometry.type == "Polygon" for r in rows)
    key = lambda rows: sorted((r.component_id, r.geometry.parts[0][0], sorted(r.geometry.parts[0][1:])) for r in rows)
    assert all(key(rows) == key(found[64]) for rows in found.values())


def test_ring_with_hole_and_diagonal_neighbour(spark):
    ring = np.array([[1, 1, 1, 0], [1, 0, 1, 0], [1, 1, 1, 0], [0, 0, 0, 1]])
    for tile in (2, 64):
        polys = [r.geometry.parts[0] for r in polygons(spark, ring, tile)]
        assert sorted(len(p) for p in polys) == [1, 2]
        outer, hole = [p for p in polys if len(p) == 2][0]
        assert len(outer) == 5 and len(hole) == 5


def test_empty_raster_has_no_polygons(spark):
    assert polygons(spark, np.zeros((3, 3), int), 2) == []


def test_small_regions_drop_and_statistics_follow(spark):
    rows = [(0, 0, -0.5, 1), (0, 1, -0.3, 1), (0, 5, -0.9, 1), (3, 3, 0.1, 0)]
    diff = spark.createDataFrame(rows, "row_idx int, col_idx int, ndvi_diff double, changed int")
    got = R.detect_regions(diff, [], Grid(0, 0, 10, -10, 10, 10), min_area_m2=150.0, tile=2).collect()
    assert len(got) == 1 and got[0].area_sq_meters == 200.0 and abs(got[0].ndvi_drop_mean + 0.4) < 1e-12
    assert got[0].ndvi_drop_max == -0.3 and got[0].ndvi_diff_min == -0.5 and got[0].change_type == "VegetationLoss"


def test_ground_area_of_a_known_box(spark):
    df = spark.range(1).select(G.box(F.lit(-121.60), F.lit(39.75), F.lit(-121.59), F.lit(39.76)).alias("geometry"))
    assert abs(R.ground_area(df).collect()[0].area_sq_meters - 951000) < 2500


def test_polygons_are_dealt_over_all_partitions(spark):
    """Many small regions are few bytes; merged by size they were one task."""
    mask = np.zeros((40, 40), int)
    mask[::2, ::2] = 1
    made = R.region_polygons(R.label_regions(pixels(spark, mask), ["scene"], tile=8), ["scene"], None, tile=8)
    assert made.count() == 400
    assert made.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
