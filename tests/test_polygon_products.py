import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from landwatch.operators import pointcloud as C

POINT = "x double, y double, z double, classification int, return_number int"


def test_products_of_boxes_without_a_pair_of_box_and_point(spark, monkeypatch):
    """Boxes cut squares anywhere; the sums of squares give what the listed pairs gave."""
    rng = np.random.default_rng(3)
    points = [(float(a), float(b), None if i % 17 == 0 else float(h), int(k), int(n)) for i, (a, b, h, k, n) in enumerate(zip(
        np.round(rng.uniform(-3, 7, 900), 2), np.round(rng.uniform(-3, 7, 900), 2), rng.uniform(0, 9, 900), rng.integers(1, 4, 900), rng.integers(1, 4, 900)))]
    points += [(2.5, 2.5, 4.0, 2, 1), (2.5, 2.5, 3.0, 2, 2), (1.5, 0.5, None, 2, 1), (None, 1.0, 5.0, 2, 1), (4.0, 4.0, 7.0, None, None)] * 2
    boxes = [(f"b{i}", float(a), float(b), float(a + w), float(b + h)) for i, (a, b, w, h) in enumerate(zip(*rng.uniform(-4, 6, (2, 30)), *rng.uniform(0, 3, (2, 30))))]
    boxes += [("whole", 0.0, 0.0, 2.0, 2.0), ("whole", 0.0, 0.0, 2.0, 2.0), ("none", 50.0, 50.0, 51.0, 51.0), ("null", None, 0.0, 1.0, 1.0), ("turned", 2.0, 2.0, 0.0, 0.0)]
    p, b = spark.createDataFrame(points, POINT), spark.createDataFrame(boxes, "k string, min_x double, min_y double, max_x double, max_y double")
    wide = b.select("k", *[(F.col(n) + s).alias(n) for n, s in (("min_x", -0.3), ("min_y", -0.3), ("max_x", 0.3), ("max_y", 0.3))])
    key = lambda r: (r.k, r.cell_row, r.cell_col)
    want = {key(r): (r.dtm, r.dsm, r.chm) for r in C.products(C.polygon_points(wide, p, "k", 10.0), ["k"]).collect()}
    monkeypatch.setattr(C, "polygon_points", lambda *a: pytest.fail("pairs of boxes and points were listed"))
    for rows in (50_000, 3):
        got = {key(r): (r.dtm, r.dsm, r.chm) for r in C.polygon_products(b, p, "k", 0.3, rows=rows).collect()}
        assert got.keys() == want.keys() and len(got) > 300
        for k, v in want.items():
            assert all((a is None) == (e is None) and (a is None or math.isclose(a, e, rel_tol=1e-9, abs_tol=1e-9)) for a, e in zip(got[k], v))


def test_square_sums_keep_wild_heights_to_their_cuts():
    x, y, z = np.array([0.2, 0.7]), np.array([0.2, 0.7]), np.ma.array([np.inf, 2.0], mask=[False, False])
    yes = np.array([True, True])
    cuts = np.array([[-np.inf, -np.inf, 0.5, 0.5], [0.5, 0.5, np.inf, np.inf]])
    cells, w, wz, n, exact, top = C.cut_sums(x, y, z, yes, yes, cuts, 1.0, math.sqrt(2), 1.0, most=1)
    own = cells.index((0, 0))
    assert wz[0, own] == np.inf and math.isclose(wz[1, own] / w[1, own], 2.0) and n[:, own].tolist() == [1, 1]
    assert top[0, own] == np.inf and top[1, own] == 2.0 and exact.mask.all()
