"""Risk scoring of (change, asset) pairs as one chain of column expressions."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landwatch.config import scoring_config
from landwatch.schema import CRITICALITIES, name_of

LANDSLIDE = "LandslideDebris"
UPSLOPE_M = 5.0  # fixed value: height that makes a landslide threatening


def _first(rules, test, value, default) -> Column:
    """Value of the first rule whose test holds."""
    out = None
    for rule in rules:
        out = (F if out is None else out).when(test(rule), F.lit(value(rule)))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def _ladder(rules, test, default_code: str) -> tuple[Column, Column]:
    return (
        _first(rules, test, lambda r: int(r["points"]), 0),
        _first(rules, test, lambda r: r["reason_code"], default_code),
    )


def distance_points(meters: Column, config: dict[str, Any]) -> tuple[Column, Column]:
    """Points and reason code for the distance to the asset."""
    return _ladder(config["distance"]["thresholds"], lambda r: meters < float(r["distance_m"]), "DISTANCE_FAR")


def ndvi_points(drop: Column, config: dict[str, Any]) -> tuple[Column, Column]:
    """Points and reason code for the mean vegetation-index difference."""
    return _ladder(config["ndvi_drop"]["thresholds"], lambda r: drop <= float(r["delta"]), "NDVI_DROP_MINIMAL")


def area_points(area: Column, config: dict[str, Any]) -> tuple[Column, Column]:
    """Points and reason code for the changed area."""
    return _ladder(config["area"]["thresholds"], lambda r: area >= float(r["area_m2"]), "AREA_SMALL")


def slope_points(slope: Column, config: dict[str, Any]) -> tuple[Column, Column]:
    """Points and reason code for the slope alone."""
    return _ladder(config["slope"]["thresholds"], lambda r: slope >= float(r["slope_deg"]), "SLOPE_FLAT")


def slope_modifier(diff: Column, config: dict[str, Any]) -> Column:
    """Directional factor on the slope points; diff is change height minus asset height."""
    c = config["directional_slope"]
    up = float(c["upslope_multiplier_max"]) - float(c["upslope_multiplier_base"])
    down = float(c["downslope_multiplier_base"]) - float(c["downslope_multiplier_min"])
    raised = F.lit(float(c["upslope_multiplier_base"])) + F.least(
        F.lit(up), F.lit(up) * diff / F.lit(float(c["upslope_elev_scale"])))
    lowered = F.lit(float(c["downslope_multiplier_base"])) - F.least(
        F.lit(down), F.lit(down) * F.abs(diff) / F.lit(float(c["downslope_elev_scale"])))
    return (
        F.when(diff > float(c["upslope_threshold_m"]), raised)
        .when(diff < float(c["downslope_threshold_m"]), lowered)
        .otherwise(F.lit(1.0))
    )


def directional_slope_points(slope: Column, diff: Column, config: dict[str, Any]) -> tuple[Column, Column]:
    """Points and reason code for slope with its direction; a null diff leaves the slope alone."""
    c = config["directional_slope"]
    base, base_code = slope_points(slope, config)
    scaled = F.least(F.lit(int(c["max_points"])), (base * slope_modifier(diff, config)).cast("int"))
    code = (
        F.when(diff.isNull(), base_code)
        .when(diff > float(c["upslope_threshold_m"]), F.lit("SLOPE_UPSLOPE"))
        .when(diff < float(c["downslope_threshold_m"]), F.lit("SLOPE_DOWNSLOPE"))
        .otherwise(F.lit("SLOPE_LEVEL"))
    )
    return F.when(diff.isNull(), base).otherwise(scaled), code


def aspect_points(aspect: Column, config: dict[str, Any]) -> tuple[Column, Column]:
    """Points and reason code of half-open aspect ranges; uncovered angles score 0."""
    a = F.pmod(aspect, F.lit(360.0))
    return _ladder(
        config["aspect"]["ranges"],
        lambda r: (a >= float(r["min_deg"])) & (a < float(r["max_deg"])), "ASPECT_OTHER")


def compass(aspect: Column) -> Column:
    """Eight-point compass name of an aspect in degrees."""
    names = F.array(*[F.lit(n) for n in ("N", "NE", "E", "SE", "S", "SW", "W", "NW")])
    sector = F.floor((F.pmod(aspect, F.lit(360.0)) + 22.5) / 45.0).cast("int") % 8
    return F.get(names, sector)


def land_cover_multiplier(land_cover: Column, config: dict[str, Any]) -> Column:
    """Multiplier of a land-cover class; unknown or missing classes give 1."""
    pairs = config["land_cover"]["multipliers"]
    if not pairs:
        return F.lit(1.0)
    table = F.create_map(*[F.lit(v) for n, m in pairs.items() for v in (n, float(m))])
    return F.coalesce(table[land_cover], F.lit(1.0))


def landslide_multiplier(diff: Column, config: dict[str, Any]) -> Column:
    """Multiplier of a confirmed landslide, raised when it lies above the asset."""
    c = config["landslide"]
    boosted = min(float(c["multiplier"]) + float(c["upslope_boost"]), float(c["max_multiplier"]))
    return F.when(diff > UPSLOPE_M, F.lit(boosted)).otherwise(F.lit(float(c["multiplier"])))


def criticality_multiplier(criticality: Column, config: dict[str, Any]) -> Column:
    """Multiplier of an asset criticality code; unknown codes give 1."""
    pairs = config["criticality"]["multipliers"]
    if not pairs:
        return F.lit(1.0)
    table = F.create_map(*[F.lit(v) for k, m in pairs.items() for v in (int(k), float(m))])
    return F.coalesce(table[criticality.cast("int")], F.lit(1.0))


def risk_level(score: Column, config: dict[str, Any]) -> Column:
    """Level name of a score, "Unknown" outside every range."""
    return _first(
        config["risk_levels"],
        lambda r: (score >= int(r["min_score"])) & (score <= int(r["max_score"])),
        lambda r: r["name"], "Unknown")


def fixed(value: Column, digits: int) -> Column:
    """Number with a fixed count of decimals; a decimal cast is several times cheaper than a format string."""
    return value.cast("double").cast(f"decimal(38,{digits})").cast("string")


def _text(*pieces) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces])


def _factor(name, points, max_points: int, code, details) -> Column:
    text = F.lit(name) if isinstance(name, str) else name
    return F.struct(text.alias("name"), points.alias("points"), F.lit(int(max_points)).alias("max_points"),
                    code.alias("reason_code"), details.alias("details"))


def score_pairs(pairs: DataFrame, overrides: dict[str, Any] | None = None) -> DataFrame:
    """Add base_score (before criticality), risk_score, risk_level and the ordered factors list to (change, asset) pairs.

    Reads distance_meters, ndvi_drop_mean, area_sq_meters, change_type (name), criticality (code),
    criticality_name, and the nullable slope_degree_mean, aspect_degrees, land_cover_class and
    elevation_diff_m. Every product is truncated before the next one. The factor texts are separate
    expressions, so a caller that keeps only the score never pays for them.
    """
    config = scoring_config(overrides)
    c = F.col
    diff, slope, aspect, cover = c("elevation_diff_m"), c("slope_degree_mean"), c("aspect_degrees"), c("land_cover_class")
    dist_p, dist_code = distance_points(c("distance_meters"), config)
    ndvi_p, ndvi_code = ndvi_points(c("ndvi_drop_mean"), config)
    area_p, area_code = area_points(c("area_sq_meters"), config)
    slope_p, slope_code = directional_slope_points(slope, diff, config)
    aspect_p, aspect_code = aspect_points(aspect, config)
    keep = pairs.columns

    df = pairs.withColumns({
        "_dist": dist_p, "_ndvi": ndvi_p, "_area": area_p,
        "_slope": F.when(slope.isNotNull(), slope_p), "_aspect": F.when(aspect.isNotNull(), aspect_p),
        "_slide": F.coalesce(c("change_type") == LANDSLIDE, F.lit(False)),
        "_cover_m": land_cover_multiplier(cover, config),
        "_slide_m": landslide_multiplier(diff, config),
        "_crit_m": criticality_multiplier(c("criticality"), config),
    })
    df = df.withColumn("_t0", c("_dist") + c("_ndvi") + c("_area")
                       + F.coalesce(c("_slope"), F.lit(0)) + F.coalesce(c("_aspect"), F.lit(0)))
    skipped = c("_slide") & (c("_cover_m") < 1.0)
    df = df.withColumn("_t1", F.when(skipped | (c("_cover_m") == 1.0), c("_t0"))
                       .otherwise((c("_t0") * c("_cover_m")).cast("int")))
    steep = F.coalesce(slope, F.lit(0.0)) >= float(config["landslide"]["min_slope_deg"])
    df = df.withColumn("_t2", F.when(c("_slide") & steep, (c("_t1") * c("_slide_m")).cast("int")).otherwise(c("_t1")))
    df = df.withColumn("risk_score", F.least(F.lit(100.0), c("_t2") * c("_crit_m")).cast("int"))
    df = df.withColumn("risk_level", risk_level(c("risk_score"), config))

    d = config["directional_slope"]
    rise = (F.when(diff > float(d["upslope_threshold_m"]), _text("upslope (", fixed(diff, 0), "m higher)"))
            .when(diff < float(d["downslope_threshold_m"]), _text("downslope (", fixed(F.abs(diff), 0), "m lower)"))
            .otherwise(F.lit("approximately level")))
    slope_text = F.when(diff.isNull(), _text("Slope: ", fixed(slope, 1), "° (no elevation data)")).otherwise(
        _text("Slope: ", fixed(slope, 1), "°, ", rise, " (modifier: ", fixed(slope_modifier(diff, config), 2), "x)"))
    angle = F.pmod(aspect, F.lit(360.0))
    unmatched = lambda code, default: F.when(code == default, F.lit(" (below threshold)")).otherwise(F.lit(""))

    cover_code = F.concat(F.lit("LANDCOVER_"), F.upper(cover))
    cover_factor = (
        F.when(skipped, F.array(_factor(
            "Land Cover", F.lit(0), 0, F.concat(cover_code, F.lit("_SKIP")),
            _text("Land cover: ", cover, " (multiplier: ", fixed(c("_cover_m"), 2), "x, skipped for confirmed landslide)"))))
        .when(c("_cover_m") != 1.0, F.array(_factor(
            "Land Cover", c("_t1") - c("_t0"), 0, cover_code,
            _text("Land cover: ", cover, " (multiplier: ", fixed(c("_cover_m"), 2), "x)"))))
        .when(cover.isNotNull(), F.array(_factor(
            "Land Cover", F.lit(0), 0, cover_code,
            _text("Land cover: ", cover, " (multiplier: 1.00x, baseline)"))))
    )
    gate = float(config["landslide"]["min_slope_deg"])
    position = (F.when(diff > UPSLOPE_M, _text("upslope (", fixed(diff, 0), "m higher)"))
                .when(diff < -UPSLOPE_M, _text("downslope (", fixed(F.abs(diff), 0), "m lower)"))
                .otherwise(F.lit("level/unknown terrain")))
    grade = F.coalesce(slope, F.lit(0.0))
    slide_factor = F.when(c("_slide") & ~steep, _factor(
        "Landslide Detection", F.lit(0), 0, F.lit("LANDSLIDE_LOW_SLOPE"),
        _text("Landslide detected but slope ", fixed(grade, 1), f"° < {gate:.0f}° threshold"))
    ).when(c("_slide"), _factor(
        "Landslide Detection", c("_t2") - c("_t1"), 0,
        F.when(diff > UPSLOPE_M, F.lit("LANDSLIDE_UPSLOPE")).otherwise(F.lit("LANDSLIDE_DETECTED")),
        _text("Landslide on ", fixed(grade, 1), "° slope, ", position, " (multiplier: ", fixed(c("_slide_m"), 2), "x)")))

    # Optional factors are arrays of one or none, so their texts stay in generated code. The rare
    # landslide factor goes through array_compact, which keeps this projection out of the whole-stage
    # method: as one method it would be too large for the JIT, on its own Spark splits it.
    none = F.array()
    factors = F.concat(
        F.array(
            _factor("Distance", c("_dist"), config["distance"]["max_points"], dist_code,
                    F.concat(_text("Distance: ", fixed(c("distance_meters"), 0), "m"),
                             F.when(dist_code == "DISTANCE_FAR", F.lit(" (beyond threshold)")).otherwise(F.lit("")))),
            _factor("NDVI Drop", c("_ndvi"), config["ndvi_drop"]["max_points"], ndvi_code,
                    F.concat(_text("NDVI drop: ", fixed(c("ndvi_drop_mean"), 3)), unmatched(ndvi_code, "NDVI_DROP_MINIMAL"))),
            _factor("Area", c("_area"), config["area"]["max_points"], area_code,
                    F.concat(_text("Area: ", F.format_number(c("area_sq_meters").cast("double"), 0), " m²"), unmatched(area_code, "AREA_SMALL")))),
        F.when(slope.isNotNull(), F.array(_factor(
            F.when(diff.isNull(), F.lit("Slope")).otherwise(F.lit("Slope + Direction")),
            c("_slope"), d["max_points"], slope_code, slope_text))).otherwise(none),
        F.when(aspect.isNotNull(), F.array(_factor(
            "Aspect", c("_aspect"), config["aspect"]["max_points"], aspect_code,
            _text("Aspect: ", fixed(angle, 0), "° (", compass(aspect), ")")))).otherwise(none),
        cover_factor.otherwise(none),
        F.array_compact(F.array(slide_factor)),
        F.array(_factor(
            "Criticality",
            F.when(c("_crit_m") > 1.0, (c("_t2") * (c("_crit_m") - 1.0)).cast("int")).otherwise(F.lit(0)),
            config["criticality"]["max_points"],
            F.concat(F.lit("CRITICALITY_"), F.upper(c("criticality_name"))),
            F.concat(F.lit("Multiplier: "), c("_crit_m").cast("string"), F.lit("x for "),
                     c("criticality_name"), F.lit(" criticality")))))
    return df.withColumn("factors", factors).select(*keep, c("_t2").alias("base_score"), "risk_score", "risk_level", "factors")


def score_classes(changes: DataFrame, overrides: dict[str, Any] | None = None) -> DataFrame:
    """Changes whose scored columns are values that stand for all of their class: score and level of a pair stay as they are, its texts do not.

    Adds _kind, what a height difference can alter: twice the slope points, and one more for a landslide steep enough to count.
    """
    config, c = scoring_config(overrides), F.col
    slope, aspect, turn = c("slope_degree_mean"), c("aspect_degrees"), F.pmod(c("aspect_degrees"), F.lit(360.0))
    gate = float(config["landslide"]["min_slope_deg"])
    grades = sorted({gate, *(float(r["slope_deg"]) for r in config["slope"]["thresholds"])})
    turns = sorted({0.0, *(float(r[k]) for r in config["aspect"]["ranges"] for k in ("min_deg", "max_deg") if 0 <= float(r[k]) < 360)})
    slide = F.coalesce(c("change_type") == LANDSLIDE, F.lit(False))
    base = F.coalesce(slope_points(slope, config)[0], F.lit(0))
    steep = F.coalesce(slope, F.lit(0.0)) >= gate
    return changes.withColumns({
        "_kind": F.when(slope.isNull(), 0).otherwise(base * 2).cast("long") + (slide & steep).cast("long"),
        "ndvi_drop_mean": _first(config["ndvi_drop"]["thresholds"], lambda r: c("ndvi_drop_mean") <= float(r["delta"]), lambda r: float(r["delta"]), None).cast("double"),
        "area_sq_meters": _first(config["area"]["thresholds"], lambda r: c("area_sq_meters") >= float(r["area_m2"]), lambda r: float(r["area_m2"]), None).cast("double"),
        "slope_degree_mean": F.when(slope.isNotNull(), _first(grades[::-1], lambda g: slope >= g, lambda g: g, grades[0] - 1.0)),
        "aspect_degrees": F.when(F.isnan(aspect), aspect).when(aspect.isNotNull(), _first(turns[::-1], lambda g: turn >= g, lambda g: g, 0.0)),
        "land_cover_class": F.when(c("land_cover_class").isin(list(config["land_cover"]["multipliers"])), c("land_cover_class")),
        "change_type": F.when(slide, F.lit(LANDSLIDE)),
    })


def rise_steps(overrides: dict[str, Any] | None = None) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Whole numbers that tell height differences apart as far as the score of a change of some _kind does; ``slope_modifier`` in numpy, same operations.

    Slope points are monotone in the difference within each of its ranges, so differences between two of one number have that number.
    """
    d = scoring_config(overrides)["directional_slope"]
    up = float(d["upslope_multiplier_max"]) - float(d["upslope_multiplier_base"])
    down = float(d["downslope_multiplier_base"]) - float(d["downslope_multiplier_min"])

    def steps(diff: np.ndarray, kind: np.ndarray) -> np.ndarray:
        base = kind >> 1
        high, low = diff > float(d["upslope_threshold_m"]), diff < float(d["downslope_threshold_m"])
        raised = float(d["upslope_multiplier_base"]) + np.minimum(up, up * diff / float(d["upslope_elev_scale"]))
        lowered = float(d["downslope_multiplier_base"]) - np.minimum(down, down * np.abs(diff) / float(d["downslope_elev_scale"]))
        points = np.clip(np.minimum(int(d["max_points"]), np.trunc(base * np.where(high, raised, np.where(low, lowered, 1.0)))), -(1 << 20), 1 << 20).astype(np.int64)
        part = np.where(base != 0, high + 2 * low, 0)
        return (points + (1 << 20)) * 8 + part * 2 + (kind & 1) * (diff > UPSLOPE_M)

    return steps


def scoring_document(score: Column, level: Column, factors: Column) -> Column:
    """Score, level and factors as one JSON text."""
    return F.to_json(F.struct(score.alias("total_score"), level.alias("risk_level"), factors.alias("factors")))


def with_criticality_name(df: DataFrame) -> DataFrame:
    """Add the criticality name, "Medium" when the code is unknown."""
    return df.withColumn("criticality_name",
                         F.coalesce(name_of(CRITICALITIES, F.col("criticality")), F.lit("Medium")))
