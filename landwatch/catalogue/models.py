"""Point-cloud grids, patches, model outputs and training statistics."""

import numpy as np
from pyspark.sql import functions as F

from landwatch.catalogue.rasters import grid, terrain
from landwatch.catalogue.registry import query
from landwatch.operators import patches as P
from landwatch.operators import pointcloud as C
from landwatch.operators import training as T
from landwatch.schema import LAND_COVER_CLASSES

c = F.col
CELLS = """nb AS (SELECT *, floor(x) + dc AS cell_col, floor(y) + dr AS cell_row, sqrt((x - floor(x) - dc - 0.5) * (x - floor(x) - dc - 0.5) + (y - floor(y) - dr - 0.5) * (y - floor(y) - dr - 0.5)) AS d
 FROM {0} CROSS JOIN (VALUES (-2), (-1), (0), (1), (2)) a(dc) CROSS JOIN (VALUES (-2), (-1), (0), (1), (2)) b(dr)), nr AS (SELECT * FROM nb WHERE d < sqrt(2))"""
GRIDS = CELLS + """, dtm AS (SELECT {1} cell_row, cell_col, sum(z / d) / sum(1 / d) AS dtm FROM nr WHERE classification = 2 GROUP BY ALL),
dsm AS (SELECT {1} cell_row, cell_col, max(z) AS dsm FROM nr WHERE return_number = 1 GROUP BY ALL)"""


@query("points", f"""WITH {GRIDS.format('points', '')} SELECT cell_row::BIGINT AS cell_row, cell_col::BIGINT AS cell_col, round(dtm, 6) AS dtm, round(dsm, 6) AS dsm, round(greatest(dsm - dtm, 0), 6) AS chm
FROM dtm LEFT JOIN dsm USING (cell_row, cell_col) WHERE dsm IS NOT NULL UNION ALL SELECT cell_row::BIGINT, cell_col::BIGINT, round(dtm, 6), NULL, NULL FROM dtm ANTI JOIN dsm USING (cell_row, cell_col)""")
def terrain_products(t):
    """Terrain, surface and height per one-metre cell."""
    g = C.products(t.points, [])
    return g.select("cell_row", "cell_col", *[F.round(k, 6).alias(k) for k in ("dtm", "dsm", "chm")])


@query("points", """SELECT count(*) FILTER (classification = 2) + count(*) FILTER (return_number = 1) AS point_count,
round((count(*) FILTER (classification = 2) + count(*) FILTER (return_number = 1)) / 2500.0, 2)::DOUBLE AS point_density_per_m2, 32610 AS crs_epsg, 1.0::DOUBLE AS resolution_m,
count(*) FILTER (classification = 5) AS vegetation_points FROM points""")
def point_cloud_metadata(t):
    m = C.metadata(t.points, [], F.lit(2500.0), F.lit(32610), 1.0)
    return m.withColumn("vegetation_points", c("classification_counts")[5]).drop("classification_counts")


def boxes(t):
    """Boxes of landslide polygons in the point cloud's plane."""
    k, tall = c("s_suppkey"), grid(t).rows * 10
    return t.supplier.select(F.concat(F.lit("poly-"), k).alias("polygon_id"), (k * 7 % 45 + 1).cast("double").alias("min_x"),
                             (k * 11 % 45 + 1).cast("double").alias("min_y")).withColumns({"max_x": c("min_x") + 2, "max_y": c("min_y") + 2})


BOXED = """bx AS (SELECT concat('poly-', s_suppkey) AS polygon_id, s_suppkey * 7 % 45 + 1 AS bx0, s_suppkey * 11 % 45 + 1 AS by0 FROM supplier),
pp AS (SELECT polygon_id, p.* FROM bx JOIN points p ON x BETWEEN bx0 - 1 AND bx0 + 3 AND y BETWEEN by0 - 1 AND by0 + 3)"""


@query("points", f"""WITH {BOXED}, {GRIDS.format('pp', 'polygon_id,')} SELECT polygon_id, count(*) AS cells, round(sum(dtm), 5) AS dtm_sum, round(sum(dsm), 5) AS dsm_sum,
round(sum(greatest(dsm - dtm, 0)) FILTER (dsm IS NOT NULL), 5) AS chm_sum FROM dtm LEFT JOIN dsm USING (polygon_id, cell_row, cell_col) GROUP BY polygon_id""")
def polygon_terrain_products(t):
    """Products inside the widened box of every landslide polygon, summed per polygon."""
    g = C.polygon_products(boxes(t), t.points, "polygon_id", 1.0)
    return g.groupBy("polygon_id").agg(F.count("*").alias("cells"), *[F.round(F.sum(k), 5).alias(f"{k}_sum") for k in ("dtm", "dsm", "chm")])


@query("", """SELECT tile_id, href FROM (SELECT concat('t', lpad(p_partkey::VARCHAR, 7, '0')) AS tile_id, p_partkey % 3 <> 0 AS has_data, concat('s3://pc/', p_partkey, '.laz') AS href FROM part
WHERE p_partkey % 100 <= 30 AND p_partkey % 100 + 5 >= 10 AND p_size <= 30 AND p_size + 5 >= 10) WHERE has_data""")
def point_tiles(t):
    """Point-cloud tiles over a box that have a data file."""
    k = c("p_partkey")
    name = F.when(k % 3 == 0, "thumbnail").otherwise("data")
    tiles = t.part.select(
        F.concat(F.lit("t"), F.lpad(k.cast("string"), 7, "0")).alias("tile_id"), (k % 100).cast("double").alias("min_x"), c("p_size").cast("double").alias("min_y"),
        F.create_map(name, F.struct(F.concat(F.lit("s3://pc/"), k, F.lit(".laz")).alias("href"))).alias("assets"))
    tiles = tiles.withColumns({"max_x": c("min_x") + 5, "max_y": c("min_y") + 5})
    return C.search_tiles(tiles, (10.0, 10.0, 30.0, 30.0)).select("tile_id", "href")


@query("points", "SELECT classification, count(*) AS points, round(sum(z), 4) AS z_sum FROM points WHERE x BETWEEN 10 AND 20.25 AND y BETWEEN 5 AND 30 GROUP BY classification")
def points_in_box(t):
    return C.within(t.points, (10.0, 5.0, 20.25, 30.0)).groupBy("classification").agg(F.count("*").alias("points"), F.round(F.sum("z"), 4).alias("z_sum"))


@query("pixels", """WITH s AS (SELECT greatest(1, (max(row_idx) + 1) // 40) AS sy, greatest(1, (max(col_idx) + 1) // 40) AS sx, max(row_idx) + 1 AS h, max(col_idx) + 1 AS w, min(elevation_m) AS lo, max(elevation_m) AS hi FROM pixels)
SELECT CAST(row_idx // sy AS INT) AS row, CAST(col_idx // sx AS INT) AS col, round((elevation_m - lo) / (hi - lo), 6) AS height FROM pixels, s WHERE row_idx % sy = 0 AND col_idx % sx = 0
AND row_idx // sy < h // sy AND col_idx // sx < w // sx""")
def surface_sample(t):
    """Thinned elevation surface with heights from 0 to 1."""
    s = C.surface_sample(t.pixels.select("row_idx", "col_idx", "elevation_m"), [], "elevation_m", most=40)
    return s.withColumn("height", F.round("height", 6))


# --- patches -------------------------------------------------------------------

def centres(t):
    k, tall = c("s_suppkey"), grid(t).rows * 10
    return t.supplier.select(F.concat(F.lit("p-"), k).alias("polygon_id"), (k * 137 % 1280).cast("double").alias("px"),
                             (-(k * 211 % tall)).cast("double").alias("py"), (k % 30).cast("double").alias("slope_degree_mean"))


WINDOW = """ce AS (SELECT concat('p-', s_suppkey) AS polygon_id, least(127, s_suppkey * 137 % 1280 // 10) AS k, s_suppkey * 211 % (10 * h) // 10 AS r, s_suppkey % 30 AS slope, h FROM supplier CROSS JOIN (SELECT max(row_idx) + 1 AS h FROM pixels)),
wi AS (SELECT *, greatest(r - 16, 0) AS r0, least(r + 16, h) AS r1, greatest(k - 16, 0) AS c0, least(k + 16, 128) AS c1 FROM ce),
pa AS (SELECT polygon_id, slope, row_idx - r0 + (32 - (r1 - r0)) // 2 AS p_row, col_idx - c0 + (32 - (c1 - c0)) // 2 AS p_col, red_before, nir_before, elevation_m
 FROM wi JOIN pixels ON row_idx >= r0 AND row_idx < r1 AND col_idx >= c0 AND col_idx < c1)"""


def patches(t, values):
    found = P.patch_pixels(centres(t), t.pixels, grid(t), "polygon_id", "px", "py", 32, values)
    return P.dense_patches(found, "polygon_id", 32, values)


@query("pixels", f"""WITH {WINDOW} SELECT polygon_id, count(*) AS pixels, CAST(sum((p_row * 32 + p_col) * red_before) AS BIGINT) AS placed_sum, CAST(min(p_row) AS INT) AS first_row, CAST(min(p_col) AS INT) AS first_col FROM pa GROUP BY polygon_id""")
def patch_windows(t):
    """Pixels of the patch around each polygon centre, clamped and centred."""
    f = P.patch_pixels(centres(t), t.pixels, grid(t), "polygon_id", "px", "py", 32, ["red_before"])
    return f.groupBy("polygon_id").agg(F.count("*").alias("pixels"), F.sum((c("p_row") * 32 + c("p_col")).cast("long") * c("red_before")).alias("placed_sum"),
                                       F.min("p_row").alias("first_row"), F.min("p_col").alias("first_col"))


@query("pixels", f"""WITH {WINDOW} SELECT polygon_id, 3 AS channel_count, 1024 AS channel_size, CAST(sum(red_before) AS BIGINT) AS red_sum, CAST(sum(elevation_m) AS BIGINT) AS elevation_sum FROM pa GROUP BY polygon_id""")
def patch_channels(t):
    """Zero-padded channel arrays of each patch, scaled to reflectance."""
    p = patches(t, ["red_before", "nir_before", "elevation_m"]).withColumn("ch", P.reflectance(c("channels")))
    total = lambda i: F.aggregate(F.get("ch", F.lit(i)), F.lit(0.0), lambda a, v: a + v)
    return p.select("polygon_id", F.size("ch").alias("channel_count"), F.size(F.get("ch", F.lit(0))).alias("channel_size"),
                    F.round(total(0) * 10000).cast("long").alias("red_sum"), F.round(total(2) * 10000).cast("long").alias("elevation_sum"))


def load_cover_model():
    """Stand-in for a trained network: ten class scores from the mean of two channels."""
    return lambda block: np.stack([-np.abs(block[:, 0].mean((1, 2)) * 100 - k) for k in range(10)], 1)


@query("pixels", f"""WITH {WINDOW}, m AS (SELECT polygon_id, sum(red_before) / 1024.0 / 100 AS v FROM pa GROUP BY polygon_id)
SELECT polygon_id, CAST(least(9, round(v)) AS INT) AS class_index FROM m""")
def land_cover_by_model(t):
    """Land cover of every patch through a model function, best class by softmax."""
    out = P.classify_land_cover(patches(t, ["red_before", "nir_before"]), "polygon_id", load_cover_model, 32)
    return out.select("polygon_id", "class_index")


def load_slide_model():
    return lambda block: block[:, 0] * 2.0 + block[:, 1]


@query("pixels", f"""WITH {WINDOW}, g AS (SELECT i // 32 AS p_row, i % 32 AS p_col FROM range(1024) t(i)), al AS (SELECT c.polygon_id, coalesce(p.red_before, 0) AS a, coalesce(p.elevation_m, 0) AS b FROM ce c CROSS JOIN g
LEFT JOIN pa p ON p.polygon_id = c.polygon_id AND p.p_row = g.p_row AND p.p_col = g.p_col WHERE c.slope >= 10), pr AS (SELECT polygon_id, 1 / (1 + exp(-((a - 1000) / 500.0 * 2 + (b - 400) / 200.0))) AS p FROM al)
SELECT polygon_id, round(avg(p), 4) AS landslide_probability, round(max(p), 4) AS max_probability, count(*) FILTER (p > 0.5) / 1024.0::DOUBLE AS pixel_fraction,
avg(p) > 0.5 * 0.7 AND count(*) FILTER (p > 0.5) / 1024.0 > 0.15 AS is_landslide FROM pr GROUP BY polygon_id""")
def landslides_by_model(t):
    """Verdict on steep polygons through a model function over standardised channels."""
    out = P.classify_landslides(centres(t), patches(t, ["red_before", "elevation_m"]), "polygon_id", load_slide_model, [1000.0, 400.0], [500.0, 200.0], size=32)
    return out.select("polygon_id", F.round("landslide_probability", 4).alias("landslide_probability"), F.round("max_probability", 4).alias("max_probability"), "pixel_fraction", "is_landslide")


# --- embeddings as 8 x 8 patches -------------------------------------------------

@query("patches", """WITH e AS (SELECT patch_id, generate_subscripts(logits, 1) AS i, unnest(logits)::DOUBLE AS v FROM patches), p AS (SELECT patch_id, i, 1 / (1 + exp(-v)) AS p FROM e)
SELECT patch_id, round(avg(p), 6) AS landslide_probability, round(max(p), 6) AS max_probability, count(*) FILTER (p > 0.5) / count(*) AS pixel_fraction,
avg(p) > 0.5 * 0.7 AND count(*) FILTER (p > 0.5) / count(*) > 0.15 AS is_landslide FROM p GROUP BY patch_id""")
def landslide_verdicts(t):
    """Sigmoid probabilities and verdict of every patch."""
    v = t.patches.withColumn("p", P.sigmoid(c("logits"))).withColumns(P.landslide_verdict(c("p")))
    r = lambda k: F.round(k, 6).alias(k)
    return v.select("patch_id", r("landslide_probability"), r("max_probability"), "pixel_fraction", "is_landslide")


@query("patches", f"""WITH e AS (SELECT patch_id, generate_subscripts(logits, 1) AS i, unnest(logits)::DOUBLE AS v FROM patches), x AS (SELECT *, exp(v - max(v) OVER (PARTITION BY patch_id)) AS ev FROM e WHERE i <= 10),
s AS (SELECT *, ev / sum(ev) OVER (PARTITION BY patch_id) AS p FROM x), k AS (SELECT *, row_number() OVER (PARTITION BY patch_id ORDER BY p DESC, i) AS n FROM s)
SELECT patch_id, CAST(i - 1 AS INT) AS class_index, {LAND_COVER_CLASSES!r}[i] AS dominant_class, round(p, 6) AS confidence, (SELECT round(max(p), 6) FROM s WHERE s.patch_id = k.patch_id AND s.i = 2) AS forest_probability FROM k WHERE n = 1""")
def land_cover_verdicts(t):
    """Softmax over ten class scores and the best class."""
    v = t.patches.withColumn("p", P.softmax(F.slice("logits", 1, 10))).withColumns(P.top_class(c("p"), LAND_COVER_CLASSES))
    return v.select("patch_id", "class_index", "dominant_class", F.round("confidence", 6).alias("confidence"), F.round(c("class_probabilities")["Forest"], 6).alias("forest_probability"))


@query("patches", """WITH e AS (SELECT (generate_subscripts(logits, 1) - 1) % 8 AS k, unnest(logits)::DOUBLE AS v FROM patches)
SELECT CAST(k AS INT) AS channel, round(avg(v), 8) AS mean, round(greatest(stddev_pop(v), 1e-6), 8) AS std FROM e GROUP BY k""")
def channel_statistics(t):
    """Mean and deviation per channel (a patch column is a channel)."""
    ch = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.filter("logits", lambda v, i: i % 8 == k))
    s = T.channel_statistics(T.channel_rows(t.patches.select(ch.alias("channels"))))
    return s.select("channel", F.round("mean", 8).alias("mean"), F.round("std", 8).alias("std"))


def masks(t):
    return t.patches.select("patch_id", "logits", F.transform("logits", lambda v: (v > 0.1).cast("int")).alias("mask"))


@query("patches", """WITH e AS (SELECT (unnest(logits) > 0.1)::INT AS m FROM patches) SELECT CAST(sum(m) AS BIGINT) AS positives, count(*) AS pixels, (count(*) - sum(m)) / greatest(sum(m), 1) AS pos_weight FROM e""")
def positive_weight(t):
    return T.positive_weight(masks(t))


@query("patches", """WITH e AS (SELECT 1 / (1 + exp(-unnest(logits)::DOUBLE)) AS p, (generate_subscripts(logits, 1) + patch_id) % 3 = 0 AS y FROM patches),
n AS (SELECT count(*) FILTER (p > 0.5 AND y) AS tp, count(*) FILTER (p > 0.5 AND NOT y) AS fp, count(*) FILTER (p <= 0.5 AND y) AS fn FROM e)
SELECT tp, fp, fn, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(tp / (tp + fp + fn), 9) AS iou, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 9) AS f1 FROM n""")
def segmentation_metrics(t):
    y = F.transform("logits", lambda v, i: ((i + 1 + c("patch_id")) % 3 == 0).cast("int"))
    m = T.segmentation_metrics(t.patches.select(P.sigmoid(c("logits")).alias("p"), y.alias("y")), "p", "y")
    return m.select("tp", "fp", "fn", *[F.round(k, 9).alias(k) for k in ("precision", "recall", "iou", "f1")])


@query("patches", "SELECT patch_id, CASE WHEN list_max(logits) > 0.1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM patches")
def sample_weights(t):
    return T.sample_weights(masks(t)).select("patch_id", "weight")


@query("patches", """SELECT count(*) AS draws, true AS all_known, true AS near_share FROM patches""")
def weighted_draws(t):
    """Draws with replacement in proportion to weight: as many as patches, all known, each weight class near its share (six deviations)."""
    w = T.sample_weights(masks(t)).withColumn("weight", c("weight") / 4)
    d = T.weighted_draws(w, "patch_id", 7).join(w.select("patch_id", "weight"), "patch_id", "left").agg(
        F.count("*").alias("draws"), F.bool_and(c("weight").isNotNull()).alias("all_known"), F.count_if(c("weight") > 0.4).alias("heavy"))
    share = w.agg((F.sum(F.when(c("weight") > 0.4, c("weight")).otherwise(0)) / F.sum("weight")).alias("share"))
    off = F.abs(c("heavy") - c("draws") * c("share")) <= 6 * F.sqrt(c("draws") * c("share") * (1 - c("share"))) + 1e-9
    return d.crossJoin(share).select("draws", "all_known", off.alias("near_share"))


def files(t):
    img = t.documents.select(F.concat(F.lit("train/img/image_"), c("doc_id"), F.lit(".h5")).alias("path"))
    msk = t.labels.select(F.concat(F.lit("train/mask/mask_"), c("doc_id") * 2, F.lit(".h5")).alias("path"))
    return img, msk


@query("", """SELECT doc_id AS sample_no, concat('train/img/image_', doc_id, '.h5') AS image_path, concat('train/mask/mask_', doc_id, '.h5') AS mask_path FROM documents
WHERE doc_id IN (SELECT doc_id * 2 FROM labels)""")
def paired_files(t):
    """Image and mask files with the same number."""
    return T.pair_files(*files(t)).select("sample_no", "image_path", "mask_path")


@query("", """SELECT (SELECT count(*) FROM documents) + (SELECT count(DISTINCT doc_id) FROM labels) - 2 * (SELECT count(*) FROM documents WHERE doc_id IN (SELECT doc_id * 2 FROM labels)) AS unpaired""")
def unpaired_files(t):
    return T.unpaired_count(*files(t))
