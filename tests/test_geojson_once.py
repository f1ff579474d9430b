from pyspark.sql import functions as F

from landwatch.functions import geometry as G
from landwatch.sources.geojson import check_geometry

TEXTS = {
    "point": ('{"type":"Point","coordinates":[1.5,2]}', None), "line": ('{"type":"LineString","coordinates":[[0,0],[200,1]]}', "Coordinates outside WGS84 range"),
    "polygon": ('{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}', None), "many": ('{"type":"MultiPoint","coordinates":[[1,2],[3,4]]}', None),
    "areas": ('{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]],[[[2,2],[3,2],[3,3],[2,2]]]]}', None),
    "empty": ('{"type":"LineString","coordinates":[]}', "Invalid GeoJSON geometry"), "half": ('{"type":"Point","coordinates":[1]}', "Invalid GeoJSON geometry"),
    "kind": ('{"type":"Circle","coordinates":[1,2]}', "Invalid GeoJSON geometry"), "text": ("no json", "Invalid GeoJSON geometry"), "null": (None, "Invalid GeoJSON geometry"),
}


def test_a_geometry_text_is_read_once_a_row(spark):
    """Checks read the geometry many times; its parsing stands in the plan once for the filter (seven readings, as a point takes two), not once for each reading of it."""
    df = spark.createDataFrame([(k, t) for k, (t, _) in TEXTS.items()], "k string, t string").repartition(2)
    good, bad = check_geometry(df.select("k", G.from_geojson(F.concat("t", F.lit(""))).alias("geometry")))
    got = {r.k: r.error for r in good.select("k", F.lit(None).cast("string").alias("error")).unionByName(bad.select("k", "error")).collect()}
    assert got == {k: e for k, (_, e) in TEXTS.items()}
    for frame, most in ((good.select("k"), 7), (bad.select("k", "error"), 14)):
        assert frame._jdf.queryExecution().optimizedPlan().toString().count("from_json") <= most
    assert len(good.where("k = 'areas'").collect()[0].geometry.parts) == 2
