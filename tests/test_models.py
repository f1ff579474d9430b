import numpy as np
from pyspark.sql import functions as F

from landwatch.operators import patches as P
from landwatch.operators import pointcloud as C
from landwatch.operators import training as T
from landwatch.operators.raster import Grid

c = F.col


def test_grids_against_brute_force(spark):
    rng = np.random.default_rng(8)
    pts = [(float(x), float(y), float(z), int(k), int(n)) for x, y, z, k, n in zip(
        rng.uniform(0, 6, 200), rng.uniform(0, 6, 200), rng.uniform(0, 50, 200), rng.choice([1, 2], 200), rng.choice([1, 2], 200))]
    pts += [(2.5, 2.5, 7.0, 2, 1), (2.5, 2.5, 3.0, 2, 1)]
    df = spark.createDataFrame(pts, "x double, y double, z double, classification int, return_number int")
    got = {(r.cell_row, r.cell_col): r for r in C.products(df, []).collect()}
    for (row, col), r in got.items():
        d = [(np.hypot(x - col - 0.5, y - row - 0.5), z, k, n) for x, y, z, k, n in pts]
        near = [(q, z) for q, z, k, _ in d if k == 2 and q < np.sqrt(2)]
        exact = [z for q, z in near if q == 0]
        want = min(exact) if exact else sum(z / q for q, z in near) / sum(1 / q for q, _ in near)
        top = [z for q, z, _, n in d if n == 1 and q < np.sqrt(2)]
        assert abs(r.dtm - want) < 1e-9
        assert (r.dsm is None) == (not top)
        assert r.chm is None if not top else abs(r.chm - max(max(top) - want, 0)) < 1e-9
    assert got[(2, 2)].dtm == 3.0


def test_metadata_counts_classes(spark):
    df = spark.createDataFrame([(2, 1), (2, 2), (5, 1)], "classification int, return_number int")
    r = C.metadata(df, [], F.lit(100.0), F.lit(32610), 1.0).collect()[0]
    assert (r.point_count, r.point_density_per_m2, r.classification_counts) == (4, 0.04, {2: 2, 5: 1})


def test_patches_are_clamped_padded_and_centred(spark):
    grid = Grid(0.0, 0.0, 1.0, 1.0, 6, 9)
    px = spark.createDataFrame([(r, k, float(r * 10 + k + 1)) for r in range(6) for k in range(9)], "row_idx int, col_idx int, v double")
    z = np.array([[r * 10 + k + 1 for k in range(9)] for r in range(6)], dtype=float)
    at = {"mid": (4.2, 3.1), "corner": (0.1, 0.2), "off": (99.0, 99.0)}
    df = spark.createDataFrame([(k, x, y) for k, (x, y) in at.items()], "id string, x double, y double")
    got = {r.id: np.array(r.channels[0]).reshape(4, 4) for r in P.dense_patches(P.patch_pixels(df, px, grid, "id", "x", "y", 4, ["v"]), "id", 4, ["v"]).collect()}
    for k, (x, y) in at.items():
        row, col = min(int(y), 5), min(int(x), 8)
        part = z[max(0, row - 2):min(6, row + 2), max(0, col - 2):min(9, col + 2)]
        want = np.zeros((4, 4))
        a, b = (4 - part.shape[0]) // 2, (4 - part.shape[1]) // 2
        want[a:a + part.shape[0], b:b + part.shape[1]] = part
        assert (got[k] == want).all(), k


def test_standardising(spark):
    df = spark.createDataFrame([([[1.0, 3.0], [5.0, float("inf")], [9.0, 9.0]],)], "ch array<array<float>>")
    got = df.select(P.standardised(c("ch"), [1.0, 2.0], [2.0, 0.0])).collect()[0][0]
    assert got == [[0.0, 1.0], [5.0, 0.0], [0.0, 0.0]]


def test_failing_patches_become_null_and_the_model_loads_per_task(spark):
    df = spark.createDataFrame([(i, [[float(i)] * 4]) for i in range(6)], "id int, channels array<array<float>>").coalesce(1)

    def load():
        def predict(block):
            if (block == 3).any():
                raise ValueError("bad patch")
            return block.sum((1, 2, 3))
        return predict

    got = {r.id: r.logits for r in P.apply_model(df, "id", load, 2).collect()}
    assert got[3] is None and got[5] == [20.0] and len(got) == 6


def test_verdict_needs_both_tests(spark):
    rows = [([0.4] * 10,), ([0.9] * 2 + [0.3] * 8,), ([0.36] * 8 + [0.6] * 2,), ([0.5] * 10,)]
    df = spark.createDataFrame(rows, "p array<double>")
    assert [r.is_landslide for r in df.withColumns(P.landslide_verdict(c("p"))).collect()] == [False, True, True, False]


def test_first_of_equal_classes_wins(spark):
    df = spark.createDataFrame([([1.0, 5.0, 5.0],)], "l array<double>").withColumn("p", P.softmax(c("l"))).withColumns(P.top_class(c("p"), ["a", "b", "d"]))
    r = df.collect()[0]
    assert r.dominant_class == "b" and abs(sum(r.class_probabilities.values()) - 1) < 1e-12


def test_landslide_types_replace(spark):
    ch = spark.createDataFrame([("a", "Unknown", None, None), ("b", "Unknown", None, None)], "id string, change_type string, ml_confidence double, ml_model_version string")
    v = spark.createDataFrame([("a", True, 0.8), ("b", False, 0.2)], "id string, is_landslide boolean, landslide_probability double")
    got = {r.id: tuple(r)[1:] for r in P.refine_types(ch, v, "id", "m1").collect()}
    assert got == {"a": ("LandslideDebris", 0.8, "m1"), "b": ("Unknown", None, None)}


def test_files_pair_by_number(spark):
    img = spark.createDataFrame([("d1/image_10.h5",), ("d1/image_2.h5",), ("d1/readme.h5",), ("d1/image_7.h5",)], "path string")
    msk = spark.createDataFrame([("d2/mask_2.h5",), ("d2/mask_10.h5",), ("d2/mask_99.h5",)], "path string")
    assert [r.file_id for r in T.pair_files(img, msk).orderBy("sample_no").collect()] == ["2", "10"]
    assert T.unpaired_count(img, msk).collect()[0][0] == 2


def test_draws_follow_weights(spark):
    df = spark.range(4000).select(F.col("id").alias("k"), F.when(F.col("id") % 4 == 0, 2.0).otherwise(1.0).alias("weight"))
    d = T.weighted_draws(df, "k", 11, buckets=16)
    n, heavy = d.count(), d.where("k % 4 = 0").count()
    assert n == 4000 and abs(heavy / n - 2000 / 5000) < 0.03
    assert sorted(r.k for r in d.collect()) == sorted(r.k for r in T.weighted_draws(df, "k", 11, buckets=16).collect())


def test_metrics_without_hits_are_zero(spark):
    df = spark.createDataFrame([([0.1, 0.2], [0, 0])], "p array<double>, t array<int>")
    r = T.segmentation_metrics(df, "p", "t").collect()[0]
    assert (r.precision, r.recall, r.iou, r.f1) == (0.0, 0.0, 0.0, 0.0)
