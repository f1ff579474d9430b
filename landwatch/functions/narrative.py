"""Sentences, labels and bands shown to reviewers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display texts.
SEVERITY = {"NDVI_DROP_SEVERE": "Severe vegetation loss", "NDVI_DROP_STRONG": "Significant vegetation loss",
            "NDVI_DROP_MODERATE": "Moderate vegetation loss", "NDVI_DROP_MILD": "Mild vegetation change"}
SCHEDULES = {"0 */6 * * *": "Every 6 hours", "0 6 * * *": "Daily at 6 AM UTC", "0 6 * * 1,4": "Twice weekly (Mon/Thu)",
             "0 6 * * 1": "Weekly (Monday)"}


def _first(factors: Column, test) -> Column:
    return F.get(F.filter(factors, test), F.lit(0))


def _table(pairs: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(v) for kv in pairs.items() for v in kv])[key]


def _upslope(factors: Column) -> Column:
    slope = _first(factors, lambda f: f["reason_code"].startswith("SLOPE_"))
    return F.coalesce(slope["reason_code"] == "SLOPE_UPSLOPE", F.lit(False))


def summary(factors: Column, asset_name: Column) -> Column:
    """One or two sentences on what happened, how far from what."""
    # The phrases.
    index = _first(factors, lambda f: f["reason_code"].startswith("NDVI_DROP_"))["reason_code"]
    what = F.when(index.isNull(), F.lit("Change")).otherwise(F.coalesce(_table(SEVERITY, index), F.lit("Vegetation change")))
    metres = F.regexp_extract(_first(factors, lambda f: f["name"] == "Distance")["details"], r"Distance:\s*([\d,.]+)m", 1)
    near = F.when(F.coalesce(metres, F.lit("")) == "", F.lit(" near")).otherwise(F.concat(F.lit(" "), metres, F.lit("m from")))
    slope = F.when(_upslope(factors), F.lit(" Change is upslope, increasing debris/erosion risk.")).otherwise(F.lit(""))
    return F.concat(what, F.lit(" detected"), near, F.lit(" "), asset_name, F.lit("."), slope)


def suggested_action(factors: Column, level: Column, asset_type_name: Column) -> Column:
    """What to do at a risk level."""
    # The sentences.
    base = (F.when(level == "Critical", F.concat(F.lit("Immediate site inspection recommended. Consider protective measures for "), asset_type_name, F.lit(".")))
            .when(level == "High", F.concat(F.lit("Schedule site inspection within 48 hours. Monitor for further changes near "), asset_type_name, F.lit(".")))
            .when(level == "Medium", F.concat(F.lit("Flag for review during next scheduled inspection of "), asset_type_name, F.lit(".")))
            .otherwise(F.lit("No immediate action required. Continue routine monitoring.")))
    steep = _upslope(factors) & level.isin("Critical", "High")
    return F.concat(base, F.when(steep, F.lit(" Upslope position warrants priority attention for slope stability.")).otherwise(F.lit("")))


def factor_band(points: Column, max_points: Column) -> Column:
    """Share of the possible points: multiplier, critical, high, medium or low."""
    share = points / F.nullif(max_points, F.lit(0))
    return (F.when(max_points == 0, "multiplier").when(share >= 0.75, "critical").when(share >= 0.5, "high")
            .when(share >= 0.25, "medium").otherwise("low"))


def distance_label(meters: Column) -> Column:
    """Whole metres below a kilometre, else kilometres with one decimal."""
    return F.when(meters < 1000, F.concat(F.floor(meters + 0.5).cast("string"), F.lit("m"))).otherwise(
        F.concat(F.format_string("%.1f", meters / 1000), F.lit("km")))


def age_label(at: Column, now: Column) -> Column:
    """How long ago, in the largest whole unit up to days."""
    minutes = F.floor((F.unix_millis(now.cast("timestamp")) - F.unix_millis(at.cast("timestamp"))) / 60000)
    hours, text = F.floor(minutes / 60), lambda v, u: F.concat(v.cast("string"), F.lit(u))
    return (F.when(at.isNull(), "Never").when(minutes < 1, "Just now").when(minutes < 60, text(minutes, "m ago"))
            .when(hours < 24, text(hours, "h ago")).otherwise(text(F.floor(hours / 24), "d ago")))


def schedule_label(cron: Column) -> Column:
    """Words for a preset schedule."""
    return F.when(F.coalesce(cron, F.lit("")) == "", F.lit("Not scheduled")).otherwise(
        F.coalesce(_table(SCHEDULES, cron), F.concat(F.lit("Custom ("), cron, F.lit(")"))))
