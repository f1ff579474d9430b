"""Index rasters, regions, terrain and zonal queries."""

from pyspark.sql import functions as F

from landwatch.catalogue.registry import query
from landwatch.functions import geometry as G
from landwatch.functions import kernels as K
from landwatch.functions.change import ndvi
from landwatch.operators import raster as R
from landwatch.operators import regions as C
from landwatch.operators import terrain as T

c = F.col


def grid(t, step=1):
    """Pixels of 10 m, or ``step`` times that, over as many rows as the raster has."""
    rows = t.pixels.agg(F.max("row_idx")).first()[0]
    return R.Grid(0.0, 0.0, 10.0 * step, -10.0 * step, rows // step + 1, 128 // step)


def ndvi_side(t, side):
    return t.pixels.select("row_idx", "col_idx", ndvi(c(f"red_{side}"), c(f"nir_{side}")).alias("ndvi"))


def diff(t):
    """Difference raster, both sides computed and joined on the pixel."""
    return R.difference(ndvi_side(t, "before"), ndvi_side(t, "after"), [])


def long_bands(t):
    """Band rows of the before and after scenes."""
    rows = F.array(*[F.struct(F.lit(s).alias("scene_id"), F.lit(b).alias("band"), c(v).cast("double").alias("value"))
                     for s, b, v in (("s-before", "B04", "red_before"), ("s-before", "B08", "nir_before"), ("s-after", "B04", "red_after"),
                                     ("s-after", "B08", "nir_after"), ("s-after", "B03", "red_before"), ("s-after", "B02", "nir_before"), ("s-odd", "B04", "red_after"))])
    return t.pixels.select("row_idx", "col_idx", F.explode(rows).alias("b")).select("row_idx", "col_idx", "b.*")


NDVI = """nd AS (SELECT row_idx, col_idx, (greatest(least((nir_before - red_before)::DOUBLE / (nir_before + red_before), 1), -1))::FLOAT AS b,
 (greatest(least((nir_after - red_after)::DOUBLE / (nir_after + red_after), 1), -1))::FLOAT AS a FROM pixels)"""
DIFF = f"""{NDVI}, df AS (SELECT row_idx, col_idx, (a - b)::FLOAT AS d, CAST((a - b)::FLOAT < (-0.2)::FLOAT AS INT) AS m FROM nd)"""


@query("pixels", f"WITH {NDVI} SELECT row_idx, col_idx, round(b::DOUBLE, 6) AS ndvi_before, round(a::DOUBLE, 6) AS ndvi_after FROM nd")
def ndvi_pixels(t):
    r = lambda s: F.round(ndvi(c(f"red_{s}"), c(f"nir_{s}")).cast("double"), 6).alias(f"ndvi_{s}")
    return t.pixels.select("row_idx", "col_idx", r("before"), r("after"))


@query("pixels", f"""WITH {NDVI} SELECT scene_id, round(min(v), 6) AS min_value, round(max(v), 6) AS max_value, round(avg(v), 6) AS mean_value FROM
(SELECT 's-before' AS scene_id, b::DOUBLE AS v FROM nd WHERE b <> 0 UNION ALL SELECT 's-after', a::DOUBLE FROM nd WHERE a <> 0) GROUP BY scene_id""")
def ndvi_statistics(t):
    """Index statistics of scenes with both bands."""
    good, _ = R.scene_ndvi(long_bands(t), ["scene_id"])
    s = R.ndvi_statistics(good, ["scene_id"])
    return s.select("scene_id", *[F.round(k, 6).alias(k) for k in ("min_value", "max_value", "mean_value")])


@query("pixels", "SELECT 's-odd' AS scene_id, 'Scene missing required bands (B04, B08)' AS error, count(*) AS pixel_count FROM pixels")
def scenes_without_bands(t):
    """Scenes that cannot give an index."""
    b = long_bands(t)
    _, bad = R.scene_ndvi(b, ["scene_id"])
    return bad.join(b.groupBy("scene_id").agg(F.count("*").alias("pixel_count")), "scene_id")


@query("pixels", f"WITH {DIFF} SELECT row_idx, col_idx, round(d::DOUBLE, 6) AS ndvi_diff, m AS changed FROM df")
def change_mask(t):
    return diff(t).select("row_idx", "col_idx", F.round(c("ndvi_diff").cast("double"), 6).alias("ndvi_diff"), "changed")


@query("pixels", f"""WITH {DIFF} SELECT round(avg(d::DOUBLE) FILTER (d <> 0), 6) AS mean_diff, round(min(d::DOUBLE) FILTER (d <> 0), 6) AS min_diff,
round(max(d::DOUBLE) FILTER (d <> 0), 6) AS max_diff, CAST(sum(m) AS BIGINT) AS changed_pixels, count(*) AS total_pixels, round(sum(m) / count(*) * 100, 6) AS change_percent FROM df""")
def change_statistics(t):
    s = R.change_statistics(diff(t), [])
    return s.select(*[F.round(k, 6).alias(k) for k in ("mean_diff", "min_diff", "max_diff", "change_percent")], "changed_pixels", "total_pixels")


@query("pixels", f"""WITH {NDVI}, g AS (SELECT CASE WHEN row_idx % 7 = 0 THEN NULL ELSE b END AS b, CASE WHEN col_idx % 11 = 0 THEN NULL ELSE a END AS a FROM nd),
e AS (SELECT *, (a - b)::FLOAT AS d FROM g)
SELECT round(min(b::DOUBLE) FILTER (b <> 0), 6) AS min_before, round(max(a::DOUBLE) FILTER (a <> 0), 6) AS max_after, round(avg(d::DOUBLE) FILTER (d <> 0), 6) AS mean_diff,
round(max(d::DOUBLE) FILTER (d <> 0), 6) AS max_diff, CAST(count(*) FILTER (d < (-0.2)::FLOAT) AS BIGINT) AS changed_pixels, count(*) AS total_pixels FROM e""")
def change_with_gaps(t):
    """NaN bands on both sides: such pixels are unchanged and in no statistic."""
    nan = F.lit(float("nan"))
    p = t.pixels.select("row_idx", "col_idx", F.when(c("row_idx") % 7 == 0, nan).otherwise(c("red_before")).alias("rb"), "nir_before", "red_after",
                        F.when(c("col_idx") % 11 == 0, nan).otherwise(c("nir_after")).alias("na"))
    before = p.select("row_idx", "col_idx", ndvi(c("rb"), c("nir_before")).alias("ndvi"))
    after = p.select("row_idx", "col_idx", ndvi(c("red_after"), c("na")).alias("ndvi"))
    s = R.change_statistics(R.difference(before, after, []), [])
    low = R.ndvi_statistics(before, []).select(F.round("min_value", 6).alias("min_before"))
    high = R.ndvi_statistics(after, []).select(F.round("max_value", 6).alias("max_after"))
    return s.select(F.round("mean_diff", 6).alias("mean_diff"), F.round("max_diff", 6).alias("max_diff"), "changed_pixels", "total_pixels").crossJoin(low).crossJoin(high)


# Smallest pixel id each changed pixel can reach over shared sides.
REGION = f"""{DIFF}, px AS (SELECT row_idx AS r, col_idx AS k, row_idx * 128 + col_idx AS id, d FROM df WHERE m = 1),
adj AS (SELECT p.id AS a, q.id AS b FROM px p JOIN px q ON (q.r = p.r AND abs(q.k - p.k) = 1) OR (q.k = p.k AND abs(q.r - p.r) = 1)),
reach(id, root) AS (SELECT id, id FROM px UNION SELECT adj.b, reach.root FROM reach JOIN adj ON adj.a = reach.id WHERE adj.b > reach.root),
comp AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)"""
# min over reach along ids above the root is the component minimum, because the minimum reaches all.
REC = "WITH RECURSIVE " + REGION


@query("pixels", REC + """ SELECT component_id::BIGINT AS component_id, count(*) AS pixels, round(avg(d::DOUBLE), 6) AS ndvi_drop_mean, round(max(d)::DOUBLE, 6) AS ndvi_drop_max,
round(min(d)::DOUBLE, 6) AS ndvi_diff_min FROM comp JOIN px USING (id) GROUP BY component_id""")
def change_regions(t):
    """Connected regions of changed pixels with their difference statistics, across 32-pixel tiles."""
    d = diff(t)
    labelled = C.label_regions(d.where("changed = 1"), [], tile=32, width=128, carry=("ndvi_diff",))
    s = C.region_statistics(labelled, [])
    return s.select("component_id", "pixels", *[F.round(k, 6).alias(k) for k in ("ndvi_drop_mean", "ndvi_drop_max", "ndvi_diff_min")])


@query("pixels", REC + """, sz AS (SELECT component_id, count(*) AS pixels, avg(d::DOUBLE) AS mean_d FROM comp JOIN px USING (id) GROUP BY component_id),
sides AS (SELECT cp.component_id, sum(4 - coalesce(n.n, 0)) AS open_sides FROM comp cp LEFT JOIN (SELECT a, count(*) AS n FROM adj GROUP BY a) n ON n.a = cp.id GROUP BY 1)
SELECT (component_id // 128 * 2147483648 + component_id % 128)::BIGINT AS component_id, pixels * 100.0::DOUBLE AS area_sq_meters, pixels * 100.0::DOUBLE AS polygon_area, open_sides * 10.0::DOUBLE AS outline_m,
CASE WHEN mean_d < -0.2 THEN 'VegetationLoss' ELSE 'Unknown' END AS change_type FROM sz JOIN sides USING (component_id) WHERE pixels * 100 >= 500""")
def change_polygons(t):
    """Regions of at least 500 square metres as polygons: traced area and outline length against pixel counts."""
    found = C.detect_regions(diff(t), [], grid(t), min_area_m2=500.0, tile=32)
    g = c("geometry")
    step = lambda r: F.zip_with(F.slice(r, 1, F.size(r) - 1), F.slice(r, 2, F.size(r) - 1), lambda p, q: F.abs(q["x"] - p["x"]) + F.abs(q["y"] - p["y"]))
    length = F.aggregate(F.flatten(F.transform(F.flatten(g["parts"]), step)), F.lit(0.0), lambda a, v: a + v)
    return found.select("component_id", "area_sq_meters", G.area(g).alias("polygon_area"), length.alias("outline_m"), "change_type")


NEIGHBOR = """lim AS (SELECT min(row_idx) AS r0, max(row_idx) AS r1, min(col_idx) AS c0, max(col_idx) AS c1 FROM pixels),
st AS (SELECT p.row_idx, p.col_idx, dr, dc, coalesce(q.elevation_m, 0) AS z FROM pixels p CROSS JOIN lim CROSS JOIN (VALUES (-1), (0), (1)) a(dr) CROSS JOIN (VALUES (-1), (0), (1)) b(dc)
 LEFT JOIN pixels q ON q.row_idx = greatest(r0, least(r1, p.row_idx + dr)) AND q.col_idx = greatest(c0, least(c1, p.col_idx + dc))),
gr AS (SELECT row_idx, col_idx, (sum(CASE WHEN dc = -1 THEN z * (2 - abs(dr)) WHEN dc = 1 THEN -z * (2 - abs(dr)) ELSE 0 END)) / 80 AS dx,
 (sum(CASE WHEN dr = 1 THEN z * (2 - abs(dc)) WHEN dr = -1 THEN -z * (2 - abs(dc)) ELSE 0 END)) / 80 AS dy FROM st GROUP BY 1, 2),
ter AS (SELECT g.row_idx, g.col_idx, p.elevation_m, degrees(atan(sqrt(dx * dx + dy * dy)))::FLOAT AS slope_deg,
 (CASE WHEN degrees(atan2(-dx, dy)) < 0 THEN degrees(atan2(-dx, dy)) + 360 ELSE degrees(atan2(-dx, dy)) END)::FLOAT AS aspect_deg FROM gr g JOIN pixels p USING (row_idx, col_idx))"""


def terrain(t):
    return T.slope_aspect(t.pixels.select("row_idx", "col_idx", "elevation_m"), [], 10.0, tile=64)


@query("pixels", f"WITH {NEIGHBOR} SELECT row_idx, col_idx, round(slope_deg::DOUBLE, 4) AS slope_deg, round(aspect_deg::DOUBLE, 4) AS aspect_deg FROM ter")
def slope_and_aspect(t):
    r = lambda k: F.round(c(k).cast("double"), 4).alias(k)
    return terrain(t).select("row_idx", "col_idx", r("slope_deg"), r("aspect_deg"))


def zones(t):
    h = c("half_m")
    return t.zones.select("zone_id", G.box(c("zx") - h, c("zy") - h, c("zx") + h, c("zy") + h).alias("geometry"))


INSIDE = """ON p.col_idx * 10 + 5 BETWEEN z.zx - half_m AND z.zx + half_m AND -(p.row_idx * 10 + 5) BETWEEN z.zy - half_m AND z.zy + half_m"""


@query("pixels zones", f"""SELECT z.zone_id, count(*) AS pixels, sum(p.elevation_m) AS elevation_sum, min(row_idx) AS first_row FROM zones z JOIN pixels p {INSIDE} GROUP BY z.zone_id""")
def zonal_pixels(t):
    """Pixels whose centre lies in each zone."""
    return T.zonal_pixels(zones(t), t.pixels, grid(t), "zone_id", ["elevation_m"]).groupBy("zone_id").agg(
        F.count("*").alias("pixels"), F.sum("elevation_m").alias("elevation_sum"), F.min("row_idx").alias("first_row"))


@query("pixels zones", f"""WITH {NEIGHBOR}, zt AS (SELECT z.zone_id, avg(p.elevation_m) AS e, avg(slope_deg::DOUBLE) AS s, max(slope_deg)::DOUBLE AS x,
 degrees(atan2(avg(sin(radians(aspect_deg::DOUBLE))), avg(cos(radians(aspect_deg::DOUBLE))))) AS a FROM zones z LEFT JOIN ter p {INSIDE} GROUP BY z.zone_id)
SELECT zone_id, round(coalesce(e, 0), 4) AS elevation_m, round(coalesce(s, 0), 4) AS slope_degree_mean, round(coalesce(x, 0), 4) AS slope_degree_max,
round(coalesce(CASE WHEN a < 0 THEN a + 360 ELSE a END, 0), 4) AS aspect_degrees FROM zt""")
def zone_terrain(t):
    """Terrain statistics of zones, mean aspect on the circle, 0 for zones off the raster."""
    s = T.terrain_statistics(zones(t), terrain(t), grid(t), "zone_id")
    return s.select("zone_id", *[F.round(k, 4).alias(k) for k in ("elevation_m", "slope_degree_mean", "slope_degree_max", "aspect_degrees")])



@query("pixels assets", f"""WITH {NEIGHBOR}, pos AS (SELECT asset_id, CAST(least(127, greatest(0, floor((lon - -121.70::DOUBLE) / (0.15::DOUBLE / 128)))) AS INT) AS k,
CAST(least(n - 1, greatest(0, floor((lat - 39.76::DOUBLE) / (-0.06::DOUBLE / n)))) AS INT) AS r FROM assets CROSS JOIN (SELECT max(row_idx) + 1 AS n FROM pixels))
SELECT asset_id, elevation_m, round(CASE WHEN elevation_m IS NOT NULL THEN slope_deg::DOUBLE END, 4) AS slope_deg, round(aspect_deg::DOUBLE, 4) AS aspect_deg FROM pos LEFT JOIN ter ON row_idx = r AND col_idx = k""")
def terrain_at_assets(t):
    """Nearest elevation, slope and aspect at every asset, the whole raster laid over the first area; outside it the edge pixel counts."""
    rows = grid(t).rows
    over = R.Grid(-121.70, 39.76, 0.15 / 128, -0.06 / rows, rows, 128)
    a = R.terrain_at(t.assets.select("asset_id", "lon", "lat"), terrain(t), over, "lon", "lat")
    return a.select("asset_id", "elevation_m", F.round(c("slope_deg").cast("double"), 4).alias("slope_deg"), F.round(c("aspect_deg").cast("double"), 4).alias("aspect_deg"))


def coarse(t):
    """Elevation at half resolution."""
    return t.pixels.where("row_idx % 2 = 0 AND col_idx % 2 = 0").select(
        F.floor(c("row_idx") / 2).cast("int").alias("row_idx"), F.floor(c("col_idx") / 2).cast("int").alias("col_idx"), c("elevation_m").alias("value"))


@query("pixels", """SELECT p.row_idx, p.col_idx, q.elevation_m AS value FROM pixels p LEFT JOIN pixels q ON q.row_idx = p.row_idx // 2 * 2 AND q.col_idx = p.col_idx // 2 * 2""")
def resampled_nearest(t):
    """A half-resolution raster brought to the full grid by the nearest pixel."""
    return R.resample(coarse(t), t.pixels, [], grid(t, 2), grid(t))


@query("pixels", """WITH t AS (SELECT row_idx, col_idx, (col_idx + 0.5) / 2 - 0.5 AS fx, (row_idx + 0.5) / 2 - 0.5 AS fy FROM pixels),
k AS (SELECT row_idx, col_idx, least((SELECT max(row_idx) // 2 FROM pixels), greatest(0, floor(fy) + dr)) * 2 AS r, least(63, greatest(0, floor(fx) + dc)) * 2 AS cc,
 (CASE WHEN dr = 0 THEN 1 - (fy - floor(fy)) ELSE fy - floor(fy) END) * (CASE WHEN dc = 0 THEN 1 - (fx - floor(fx)) ELSE fx - floor(fx) END) AS w
 FROM t CROSS JOIN (VALUES (0), (1)) a(dr) CROSS JOIN (VALUES (0), (1)) b(dc))
SELECT k.row_idx, k.col_idx, round((sum(w * q.elevation_m) / sum(w) FILTER (q.elevation_m IS NOT NULL))::DOUBLE, 6) AS value FROM k LEFT JOIN pixels q ON q.row_idx = r AND q.col_idx = cc GROUP BY 1, 2""")
def resampled_bilinear(t):
    """The same by weights of the four pixels around."""
    r = R.resample(coarse(t), t.pixels, [], grid(t, 2), grid(t), "bilinear")
    return r.select("row_idx", "col_idx", F.round("value", 6).alias("value"))


@query("pixels", """SELECT row_idx, col_idx, elevation_m FROM pixels WHERE col_idx * 10 + 5 BETWEEN 203 AND 611 AND row_idx * 10 + 5 BETWEEN 100 AND 877""")
def clipped_raster(t):
    """Pixels with their centre in a box."""
    return R.clip(t.pixels, grid(t), (203.0, -877.0, 611.0, -100.0)).select("row_idx", "col_idx", "elevation_m")


@query("pixels", """SELECT scene_id, band, count(*) AS pixels, sum(v) AS total FROM (SELECT 's-after' AS scene_id, 'B03' AS band, red_before::DOUBLE AS v FROM pixels UNION ALL
SELECT 's-before', 'B08', nir_before::DOUBLE FROM pixels UNION ALL SELECT 's-after', 'B08', nir_after::DOUBLE FROM pixels) GROUP BY ALL""")
def selected_bands(t):
    """Two bands over all scenes; scenes without one of them lack its rows."""
    return R.select_bands(long_bands(t), ["B03", "B08"]).groupBy("scene_id", "band").agg(
        F.count("*").alias("pixels"), F.sum("value").alias("total"))


@query("pixels", """SELECT row_idx, col_idx, CAST(trunc(least(1.0::DOUBLE, red_after * 0.0001::DOUBLE * 3) * 255) AS INT) AS r, CAST(trunc(least(1.0::DOUBLE, red_before * 0.0001::DOUBLE * 3) * 255) AS INT) AS g,
CAST(trunc(least(1.0::DOUBLE, nir_before * 0.0001::DOUBLE * 3) * 255) AS INT) AS b FROM pixels""")
def rgb_composite(t):
    """Display bytes of the scenes that have all three colour bands."""
    return R.rgb_composite(long_bands(t), ["scene_id"]).drop("scene_id")


@query("pixels", """SELECT 's-after' AS scene_id, row_idx, col_idx, nir_before::DOUBLE AS b02, red_after::DOUBLE AS b04, 0.0::DOUBLE AS b11 FROM pixels""")
def stacked_bands(t):
    """Band stack on the reference band: absent bands 0, scenes with too few bands left out."""
    s = R.band_stack(long_bands(t), ["scene_id"], ["B02", "B03", "B04", "B08", "B11"])
    return s.select("scene_id", "row_idx", "col_idx", c("B02").alias("b02"), c("B04").alias("b04"), c("B11").alias("b11"))


@query("pixels", """SELECT row_idx, col_idx, CASE WHEN row_idx < 20 THEN elevation_m + 1000 ELSE NULL END AS lidar_m, elevation_m + CASE WHEN row_idx < 100 THEN 0 ELSE 5 END AS chosen_3dep FROM pixels""")
def dem_source_choice(t):
    """Elevation by source order: lidar where it exists; two 3dep tiles as a mosaic, the first where they overlap."""
    p = t.pixels.select("row_idx", "col_idx", "elevation_m")
    dem = (p.select(F.lit("3dep").alias("source"), F.lit("t1").alias("tile_id"), "*").where("row_idx < 100")
           .unionByName(p.select(F.lit("3dep").alias("source"), F.lit("t2").alias("tile_id"), "row_idx", "col_idx", (c("elevation_m") + 5).alias("elevation_m")).where("row_idx >= 50"))
           .unionByName(p.where("row_idx < 20").select(F.lit("lidar").alias("source"), F.lit("l1").alias("tile_id"), "row_idx", "col_idx", (c("elevation_m") + 1000).alias("elevation_m"))))
    lidar = T.choose_dem(dem, "lidar").select("row_idx", "col_idx", c("elevation_m").alias("lidar_m"))
    base = T.choose_dem(dem, "3dep").select("row_idx", "col_idx", c("elevation_m").alias("chosen_3dep"))
    return base.join(lidar, ["row_idx", "col_idx"], "left")


@query("changes", """SELECT change_id, round(lon - half_size_deg, 9) AS min_x, round(lat + half_size_deg, 9) AS max_y, round(lon, 9) AS center_x, round(lat, 9) AS center_y,
round(4 * half_size_deg * half_size_deg, 12) AS square_degrees FROM changes""")
def polygon_measures(t):
    """Bounds, centroid and planar area of the change polygons."""
    h = c("half_size_deg")
    g = t.changes.select("change_id", G.box(c("lon") - h, c("lat") - h, c("lon") + h, c("lat") + h).alias("geometry")).withColumn("ctr", G.centroid(c("geometry")))
    b = G.bounds(c("geometry"))
    return g.select("change_id", F.round(b[0], 9).alias("min_x"), F.round(b[3], 9).alias("max_y"), F.round("ctr.x", 9).alias("center_x"),
                    F.round("ctr.y", 9).alias("center_y"), F.round(G.area(c("geometry")), 12).alias("square_degrees"))
