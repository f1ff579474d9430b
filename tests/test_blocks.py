"""Ranks and pages by ranges, distances by blocks, zones by row spans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from landwatch.functions import geometry as G
from landwatch.functions import kernels as K
from tests.test_geometry import ragged


def test_rank_of_equal_values_spreads_over_ranges(spark, monkeypatch):
    from landwatch.operators import ranking
    cut = []
    monkeypatch.setattr(ranking, "_ranges", lambda *a, real=ranking._ranges: cut.append(real(*a)) or cut[-1])
    df = spark.range(4000).selectExpr("if(id % 10 = 0, null, 'k') k", "if(id < 40, null, 1.0D) d", "id t")
    got = ranking.split_rank(df, ["k"], "d", ["t"], parts=8)
    assert got.where("k = 'k' and d = 1.0").select("rank").distinct().count() == 3564
    assert cut[0].where("k = 'k'").select("_slice").distinct().count() >= 5
    want = df.selectExpr("*", "cast(row_number() over (partition by k order by d, t) as int) rank")
    assert got.exceptAll(want).count() == 0 and got.count() == 4000


@pytest.mark.parametrize("offset,limit", [(0, 7), (990, 40), (2500, 1), (3990, 50), (4000, 5)])
def test_deep_page_equals_the_sorted_slice(spark, offset, limit):
    from landwatch.operators import lists
    rows = [(i, (i * 37) % 5, None if i % 11 == 0 else i % 3) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, a int, b int").repartition(3)
    got = [r.id for r in lists.page(df, [F.col("a").desc(), F.col("b").asc_nulls_last()], "id", limit, offset, near=0).collect()]
    want = sorted(rows, key=lambda r: (-r[1], r[2] is None, r[2] or 0, r[0]))[offset:offset + limit]
    assert got == [r[0] for r in want]
    assert lists.page(df.where("false"), [], "id", limit, offset, near=0).count() == 0


def wave(n, shift):
    t = np.linspace(0, 40, n)
    return [[list(zip(t, np.sin(t) + shift))]]


def test_blocks_give_the_same_distance_as_all_segment_pairs():
    rng = np.random.default_rng(5)
    shapes = [[[[tuple(v) for v in rng.uniform(0, 9, (k, 2)) + off]]] for k, off in ((3, 0), (40, 20), (1, 5), (70, 9), (0, 0), (25, 2))]
    other = [wave(k, s) for k, s in ((60, 3), (2, 0), (90, 9), (80, 4), (5, 1), (33, 15))]
    a, b, no = K.Ragged(ragged(shapes)), K.Ragged(ragged(other)), np.zeros(6, bool)
    plain = K.pair_distance(a, no, b, no, block=10_000, most=1 << 30)
    for block, most in ((4, 50), (16, 1), (300, 200)):
        np.testing.assert_array_equal(K.pair_distance(a, no, b, no, block, most), plain)


def test_long_outlines_need_memory_of_a_block_only():
    import tracemalloc
    a, b, no = K.Ragged(ragged([wave(50_000, 0.0)])), K.Ragged(ragged([wave(50_000, 2.5)])), np.zeros(1, bool)
    tracemalloc.start()
    d = K.pair_distance(a, no, b, no)[0]
    top = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert top < 100 << 20 and 1.0 < d < 2.5  # all segment pairs at once would be 20 GB an array


def test_row_spans_equal_the_point_test():
    rng = np.random.default_rng(9)
    shapes = []
    for _ in range(12):
        t = np.sort(rng.uniform(0, 2 * np.pi, 30))
        at = rng.uniform(-5, 25, 2)
        ring = lambda r: [(at[0] + k * np.cos(u), at[1] + k * np.sin(u)) for u, k in zip([*t, t[0]], [*r, r[0]])]
        shapes.append([[ring(rng.uniform(3, 9, 30)), ring(np.full(30, 2.0))]])
    shapes += [[[[(2.5, 2.5), (6.5, 2.5), (6.5, 6.5), (2.5, 6.5), (2.5, 2.5)]]], [], [[[(1e9, 1.0), (1e9, 2.0), (1e9, 1.0)]]]]
    g = K.Ragged(ragged(shapes))
    for x0, y0, dx, dy in ((0.0, 0.0, 1.0, 1.0), (0.0, 20.0, 0.5, -0.7), (22.0, 20.0, -1.0, -1.0)):
        want = set()
        for r in range(30):
            for col in range(40):
                x, y = (col + 0.5) * dx + x0, (r + 0.5) * dy + y0
                hit = K._inside(g, np.full(len(shapes), x), np.full(len(shapes), y))
                want |= {(int(k), r, col) for k in np.flatnonzero(hit)}
        for most in (1 << 20, 5):
            got = [(int(k), int(r), col) for part in K.row_spans(g, x0, y0, dx, dy, 30, 40, most)
                   for k, r, c0, c1 in zip(*part) for col in range(c0, c1 + 1)]
            assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_zones_meet_pixels_by_row_spans(spark):
    from landwatch.operators import terrain
    from landwatch.operators.raster import Grid
    zones = spark.createDataFrame([("z", 0.0, 9.0), ("z", 30.0, 70.0), ("w", 2.0, 3.0)], "zone string, lo double, hi double").select(
        F.monotonically_increasing_id().alias("zone_id"), "zone", "lo", F.when(F.col("zone") == "z", G.box(F.col("lo"), F.col("lo"), F.col("hi"), F.col("hi"))).alias("geometry"))
    pixels = spark.range(6400).selectExpr("cast(id div 80 as int) row_idx", "cast(id % 80 as int) col_idx", "id v")
    hits = terrain.zonal_pixels(zones, pixels, Grid(0.0, 0.0, 1.0, 1.0, 80, 80), "zone_id", ["v"], tile=8)
    assert sorted(r[1] for r in hits.groupBy("zone_id").count().collect()) == [81, 1600]
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "geometry" not in plan.split("Join")[0] and terrain.zonal_pixels(zones.limit(0), pixels, Grid(0.0, 0.0, 1.0, 1.0, 80, 80), "zone_id", ["v"]).count() == 0
