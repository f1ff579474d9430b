"""Typing and naming raw map features, and building features from nodes and ways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landwatch.functions import geometry as G
from landwatch.operators.state import overlay
from landwatch.schema import ASSET_TYPES, CRITICALITIES

c = F.col
LOW, MEDIUM, HIGH, CRITICAL = (CRITICALITIES[k] for k in ("Low", "Medium", "High", "Critical"))

# Tag values by criticality, and the one criticality of single-kind sources.
BUILDING_RANK = {CRITICAL: ["hospital", "fire_station"], HIGH: ["school", "university", "college"], MEDIUM: ["commercial", "industrial", "retail"]}
ROAD_RANK = {CRITICAL: ["motorway", "trunk", "primary"], HIGH: ["secondary", "tertiary"], MEDIUM: ["residential", "service"]}
POWER_RANK = {CRITICAL: ["line"], HIGH: ["minor_line"], MEDIUM: ["tower", "pole"]}
SINGLE_KIND = {"cec_substations": ("Substation", CRITICAL), "eia_pipelines": ("GasPipeline", CRITICAL),
               "hifld_fire_stations": ("FireStation", CRITICAL), "hifld_hospitals": ("Hospital", CRITICAL), "hifld_schools": ("School", HIGH)}
VOLTAGE_RANK = {CRITICAL: 230, HIGH: 115}
AREA_TAGS = ["building", "landuse", "natural", "leisure"]


def _rank(tag: Column, table: dict[int, list[str]], default: int = LOW) -> Column:
    out = None
    for level, names in table.items():
        out = (F if out is None else out).when(tag.isin(names), F.lit(level))
    return out.otherwise(F.lit(default))


def asset_kind(source: Column, props: Column) -> dict[str, Column]:
    """Asset type code and criticality of a feature from its source and tags."""
    power, volts = F.coalesce(props["power"], F.lit("")), F.coalesce(F.try_to_number(props["VOLTAGE"], F.lit("999999999.999")).cast("double"), F.lit(0.0))
    supply = power.isin([v for names in POWER_RANK.values() for v in names])
    code = (F.when(source == "osm_buildings", ASSET_TYPES["Building"]).when(source == "osm_roads", ASSET_TYPES["Road"])
            .when((source == "osm_power") & supply, ASSET_TYPES["TransmissionLine"]).when(source == "cec_transmission", ASSET_TYPES["TransmissionLine"]))
    level = (F.when(source == "osm_buildings", _rank(F.coalesce(props["building"], F.lit("yes")), BUILDING_RANK))
             .when(source == "osm_roads", _rank(F.coalesce(props["highway"], F.lit("")), ROAD_RANK))
             .when(source == "osm_power", _rank(power, POWER_RANK))
             .when(source == "cec_transmission", F.when(volts >= VOLTAGE_RANK[CRITICAL], CRITICAL).when(volts >= VOLTAGE_RANK[HIGH], HIGH).otherwise(MEDIUM)))
    for name, (kind, rank) in SINGLE_KIND.items():
        code, level = code.when(source == name, ASSET_TYPES[kind]), level.when(source == name, rank)
    return {"asset_type": code.otherwise(ASSET_TYPES["Other"]), "criticality": level.otherwise(LOW)}


def feature_name(source: Column, props: Column, index: Column) -> Column:
    """Name tag in any of three spellings, else what the source offers, else a kind with a running number."""
    filled = lambda k: F.nullif(props[k], F.lit(""))
    number = lambda kind: F.concat(F.lit(kind + " "), (index + 1).cast("string"))
    power = props["power"]
    street, house = filled("addr:street"), filled("addr:housenumber")
    operator = F.nullif(F.coalesce(props["operator"], props["OPERATOR"]), F.lit(""))
    piping = F.nullif(F.coalesce(props["typepipe"], props["TYPEPIPE"]), F.lit(""))
    by_source = (  # fixed values: source names, tag names and display names
        F.when(source == "osm_buildings", F.coalesce(F.trim(F.concat(house, F.lit(" "), street)), street, number("Building")))
        .when(source == "osm_roads", F.coalesce(props["name"], number("Road")))
        .when(source == "osm_power", F.when(power.isin("line", "minor_line"), number("Power Line")).when(power == "tower", number("Power Tower"))
              .when(power == "pole", number("Power Pole")).otherwise(number("Power Feature")))
        .when(source == "cec_transmission", F.coalesce(F.concat(filled("OWNER"), F.lit(" "), F.nullif(filled("VOLTAGE"), F.lit("0")), F.lit("kV Line")), number("Transmission Line")))
        .when(source == "cec_substations", F.coalesce(props["SUBNAME"], number("Substation")))
        .when(source == "eia_pipelines", F.coalesce(F.concat(operator, F.lit(" - "), piping), F.concat(operator, F.lit(" Pipeline")), number("Gas Pipeline")))
        .when(source == "hifld_fire_stations", F.coalesce(props["NAME"], number("Fire Station")))
        .when(source == "hifld_hospitals", F.coalesce(props["NAME"], number("Hospital")))
        .when(source == "hifld_schools", F.coalesce(props["NAME"], number("School")))
        .otherwise(number("Feature")))
    return F.coalesce(filled("name"), filled("NAME"), filled("Name"), by_source)


def typed_assets(features: DataFrame, aoi_id: str, seq: str) -> DataFrame:
    """Assets of typed and named features; ``features`` has source, feature_id, geometry and properties."""
    return features.withColumns({**asset_kind(c("source"), c("properties")), "name": feature_name(c("source"), c("properties"), c(seq)), "aoi_id": F.lit(aoi_id)}).select(
        "aoi_id", "name", "asset_type", "criticality", "geometry", "properties", F.replace("source", F.lit("_"), F.lit("-")).alias("source_dataset"),
        c("feature_id").alias("source_feature_id"))


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """Features of all sources in one frame with their source name."""
    out = None
    for name, df in sources.items():
        one = df.withColumn("source", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def ingest_tally(rows: DataFrame) -> DataFrame:
    """Accepted and rejected rows per source, and over all sources under "total"."""
    return (rows.rollup("source").agg(F.count_if("accepted").alias("success"), F.count_if(~c("accepted")).alias("failure"))
            .withColumn("source", F.coalesce("source", F.lit("total"))))


def way_vertices(way_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(way_id, pos, x, y) of every known node of every way, in long form."""
    return way_nodes.join(nodes.select("node_id", c("lon").alias("x"), c("lat").alias("y")), "node_id").select("way_id", "pos", "x", "y")


def way_shapes(vertices: DataFrame, primary_tag: str) -> DataFrame:
    """Kind and vertex count of every way with at least two known nodes, without building its array."""
    ends = vertices.groupBy("way_id").agg(
        F.count("*").alias("vertex_count"), F.min_by(F.struct("x", "y"), "pos").alias("_a"), F.max_by(F.struct("x", "y"), "pos").alias("_b"))
    ring = (c("_a") == c("_b")) & (c("vertex_count") >= 4) & F.lit(primary_tag in AREA_TAGS)
    return (ends.where("vertex_count >= 2").withColumn("geometry_type", F.when(ring, "Polygon").otherwise("LineString")).drop("_a", "_b"))


def way_features(way_nodes: DataFrame, nodes: DataFrame, primary_tag: str, tags: DataFrame | None = None) -> DataFrame:
    """Features of all ways with at least two known nodes.

    A geometry is one value, so its vertices meet in one row; the source format allows 2000 nodes a
    way. ``way_vertices`` has the same in long form.
    """
    v = way_vertices(way_nodes, nodes)
    shapes = way_shapes(v, primary_tag)
    xy = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))), lambda p: G.vertex(p["x"], p["y"]))
    built = v.groupBy("way_id").agg(F.array(F.array(xy)).alias("_parts"))
    out = shapes.join(built, "way_id").withColumn("geometry", G.geometry(c("geometry_type"), c("_parts"))).drop("_parts")
    own = F.create_map(F.lit("osm_id"), c("way_id").cast("string"), F.lit("osm_type"), F.lit("way"))
    if tags is not None:
        out = out.join(tags, "way_id", "left").withColumn("properties", overlay(own, c("tags"))).drop("tags")
    else:
        out = out.withColumn("properties", own)
    return out.withColumn("feature_id", F.concat(F.lit("way/"), "way_id"))


def node_features(nodes: DataFrame) -> DataFrame:
    """Point features of tagged nodes (node_id, lon, lat, tags)."""
    own = F.create_map(F.lit("osm_id"), c("node_id").cast("string"), F.lit("osm_type"), F.lit("node"))
    return nodes.where(c("tags").isNotNull()).select(
        F.concat(F.lit("node/"), "node_id").alias("feature_id"), G.point(c("lon"), c("lat")).alias("geometry"), overlay(own, c("tags")).alias("properties"))
