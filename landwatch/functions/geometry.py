"""Geometry columns: a type name and parts -> rings -> vertices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from landwatch.functions import kernels as K
from landwatch.schema import PARTS


def vertex(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def geometry(kind: str | Column, parts: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("type"), parts.cast(PARTS).alias("parts"))


def point(x: Column, y: Column) -> Column:
    return geometry("Point", F.array(F.array(F.array(vertex(x, y)))))


def line(vertices: Column) -> Column:
    return geometry("LineString", F.array(F.array(vertices)))


def box(min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    """Closed rectangle, counter-clockwise from the lower left corner."""
    ring = F.array(vertex(min_x, min_y), vertex(max_x, min_y), vertex(max_x, max_y),
                   vertex(min_x, max_y), vertex(min_x, min_y))
    return geometry("Polygon", F.array(F.array(ring)))


def box_from_array(bounds: Column) -> Column:
    """Rectangle of a four-number array, null for any other length."""
    return F.when(F.size(bounds) == 4, box(*[F.get(bounds, F.lit(i)) for i in range(4)]))


def box_center(min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    return point((min_x + max_x) / 2, (min_y + max_y) / 2)


def vertices(geom: Column) -> Column:
    """All vertices of a geometry in one array."""
    return F.flatten(F.flatten(geom["parts"]))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once a row, however often ``use`` reads it.

    A column expression that is read several times is otherwise repeated in full at each place, and again where a filter is pushed below it.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def bounds(geom: Column) -> list[Column]:
    """min x, min y, max x, max y."""
    v = vertices(geom)
    xs, ys = F.transform(v, lambda p: p["x"]), F.transform(v, lambda p: p["y"])
    return [F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)]


def in_degrees(min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    """Whether bounds stay inside longitude and latitude limits."""
    return (min_x >= -180) & (max_x <= 180) & (min_y >= -90) & (max_y <= 90)


def _steps(ring: Column, step) -> Column:
    """One value per edge of a ring or line."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n), step)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def ring_area(ring: Column) -> Column:
    """Unsigned shoelace area of a closed ring, taken about its first vertex to keep digits."""
    o = F.get(ring, F.lit(0))
    cross = lambda p, q: (p["x"] - o["x"]) * (q["y"] - o["y"]) - (q["x"] - o["x"]) * (p["y"] - o["y"])
    return F.abs(_total(_steps(ring, cross))) / 2


def part_area(rings: Column) -> Column:
    """Outer ring minus holes."""
    areas = F.transform(rings, lambda r: ring_area(r))
    return F.get(areas, F.lit(0)) * 2 - _total(areas)


def area(geom: Column) -> Column:
    """Planar area of a polygon or multi-polygon, 0 for points and lines."""
    total = _total(F.transform(geom["parts"], lambda p: part_area(p)))
    return F.when(geom["type"].endswith("Polygon"), total).otherwise(F.lit(0.0))


def centroid(geom: Column) -> Column:
    """Area-weighted centroid of polygons, length-weighted of lines, mean of points."""
    return K.centroid_of(geom["type"], geom["parts"])


def largest_part(geom: Column) -> Column:
    """Polygon of the largest member by planar area; the first wins a tie."""
    ranked = F.transform(geom["parts"], lambda p, i: F.struct(part_area(p).alias("a"), (-i).alias("i"), p.alias("p")))
    best = F.array_max(F.transform(ranked, lambda r: F.struct(r["a"].alias("a"), r["i"].alias("i"))))
    rings = F.get(geom["parts"], -best["i"])
    return F.when(geom["type"] == "MultiPolygon", geometry("Polygon", F.array(rings))).otherwise(geom)


def nearest_vertex(geom: Column, x: Column, y: Column) -> Column:
    """Vertex closest to a position by squared coordinate distance; the first wins a tie."""
    ranked = F.transform(vertices(geom), lambda p, i: F.struct(
        ((p["x"] - x) * (p["x"] - x) + (p["y"] - y) * (p["y"] - y)).alias("d"), i.alias("i"), p.alias("p")))
    return F.array_min(ranked)["p"]


def focus_point(geom: Column, x: Column, y: Column) -> Column:
    """Point to show for an asset near a change: itself, its nearest vertex, or its centroid."""
    kind = geom["type"]
    return (F.when(kind == "Point", F.get(vertices(geom), F.lit(0)))
            .when(kind.endswith("LineString"), nearest_vertex(geom, x, y))
            .when(kind.endswith("Polygon"), centroid(geom)))


# --- GeoJSON ---------------------------------------------------------------

_DEPTH = {"Point": "array<double>", "MultiPoint": "array<array<double>>", "LineString": "array<array<double>>",
          "MultiLineString": "array<array<array<double>>>", "Polygon": "array<array<array<double>>>",
          "MultiPolygon": "array<array<array<array<double>>>>"}


def _xy(c: Column) -> Column:
    return vertex(F.get(c, F.lit(0)), F.get(c, F.lit(1)))


def from_geojson(text: Column) -> Column:
    """Geometry of a GeoJSON geometry text; null when it is malformed or empty."""
    ring = lambda r: F.transform(r, _xy)

    def shaped(kind, raw):
        read = lambda k: F.from_json(raw, _DEPTH[k])
        values = {
            "Point": F.array(F.array(F.array(_xy(read("Point"))))),
            "MultiPoint": F.transform(read("MultiPoint"), lambda p: F.array(F.array(_xy(p)))),
            "LineString": F.array(F.array(ring(read("LineString")))),
            "MultiLineString": F.transform(read("MultiLineString"), lambda l: F.array(ring(l))),
            "Polygon": F.array(F.transform(read("Polygon"), ring)),
            "MultiPolygon": F.transform(read("MultiPolygon"), lambda p: F.transform(p, ring)),
        }
        parts = F.lit(None).cast(PARTS)
        for name, value in values.items():
            parts = F.when(kind == name, value.cast(PARTS)).otherwise(parts)
        return geometry(kind, parts)

    def sound(bare):
        fit = bound(vertices(bare), lambda v: (F.size(v) > 0) & ~F.exists(v, lambda p: p["x"].isNull() | p["y"].isNull()))
        return F.when(F.coalesce(fit, F.lit(False)), bare)

    fields = lambda t: F.struct(F.get_json_object(t, "$.type").alias("kind"), F.get_json_object(t, "$.coordinates").alias("raw"))
    return bound(bound(text, fields), lambda f: bound(shaped(f["kind"], f["raw"]), sound))


def to_geojson(geom: Column) -> Column:
    """GeoJSON text of a geometry."""
    pair = lambda p: F.array(p["x"], p["y"])
    ring = lambda r: F.transform(r, pair)
    first = lambda c: F.get(c, F.lit(0))
    shaped = {
        "Point": pair(first(vertices(geom))),
        "MultiPoint": F.transform(geom["parts"], lambda p: pair(first(first(p)))),
        "LineString": ring(first(first(geom["parts"]))),
        "MultiLineString": F.transform(geom["parts"], lambda p: ring(first(p))),
        "Polygon": F.transform(first(geom["parts"]), ring),
        "MultiPolygon": F.transform(geom["parts"], lambda p: F.transform(p, ring)),
    }
    out = F.lit(None).cast("string")
    for name, value in shaped.items():
        out = F.when(geom["type"] == name,
                     F.to_json(F.struct(F.lit(name).alias("type"), value.alias("coordinates")))).otherwise(out)
    return out


def to_wkt(geom: Column) -> Column:
    """Well-known text of a polygon."""
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(
        r, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit(")"))
    rings = lambda p: F.concat(F.lit("("), F.array_join(F.transform(p, ring), ", "), F.lit(")"))
    return (F.when(geom["type"] == "Polygon", F.concat(F.lit("POLYGON "), rings(F.get(geom["parts"], F.lit(0)))))
            .when(geom["type"] == "MultiPolygon", F.concat(F.lit("MULTIPOLYGON ("), F.array_join(
                F.transform(geom["parts"], rings), ", "), F.lit(")"))))
