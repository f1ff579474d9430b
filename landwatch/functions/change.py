"""Vegetation index, change mask and change type as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ndvi(red: Column, nir: Column, nodata: float = 0.0) -> Column:
    """(nir - red) / (nir + red) clipped to [-1, 1]; a zero denominator gives nodata, clipped too, and NaN stays NaN."""
    r, n = red.cast("double"), nir.cast("double")
    total = n + r
    ratio = F.when(total != 0, (n - r) / total).when(total == 0, F.lit(float(nodata)))
    clipped = F.greatest(F.least(ratio, F.lit(1.0)), F.lit(-1.0))  # NaN orders above every number here
    return F.when(F.isnan(ratio), ratio).otherwise(clipped).cast("float")


def null_if_not_finite(value: Column) -> Column:
    """NaN and infinities become null."""
    v = value.cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(value)


def changed(diff: Column, threshold: float = -0.2) -> Column:
    """1 where the difference is strictly below the threshold; missing values count as unchanged.

    The threshold is taken in single precision, as the difference raster is.
    """
    limit = F.lit(threshold).cast("float").cast("double")
    return F.coalesce((F.nanvl(diff.cast("double"), F.lit(None).cast("double")) < limit).cast("int"), F.lit(0))


CROPS = ["AnnualCrop", "PermanentCrop"]
GRASS = ["HerbaceousVegetation", "Pasture"]


def change_type(mean_diff: Column, land_cover: Column | None = None) -> Column:
    """Change type name from the mean difference, refined by land cover where it is known."""
    cover = F.coalesce(land_cover, F.lit("")) if land_cover is not None else F.lit("")
    severe = (F.when(cover == "Forest", "FireBurnScar").when(cover.isin(CROPS), "AgriculturalChange")
              .otherwise("VegetationLoss"))
    mild = (F.when(cover.isin(CROPS), "AgriculturalChange").when(cover.isin(GRASS), "DroughtStress")
            .otherwise("VegetationLoss"))
    return (F.when(mean_diff < -0.4, severe).when(mean_diff < -0.2, mild)
            .when(mean_diff > 0.2, "VegetationGain").otherwise("Unknown"))


def remap_change_code(code: Column) -> Column:
    """Old change codes to the present ones; anything unmapped becomes 0."""
    # Old code -> new code.
    table = {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 3, 10: 3, 7: 4, 12: 4, 8: 5, 14: 5, 6: 6, 11: 6}
    return F.coalesce(F.create_map(*[F.lit(v) for kv in table.items() for v in kv])[code], F.lit(0))


def severity_class(mean_diff: Column) -> Column:
    """Map class of a mean difference; a shared bound belongs to the more severe class."""
    return (F.when(mean_diff.between(-1.0, -0.4), "Severe").when(mean_diff.between(-0.4, -0.3), "Strong")
            .when(mean_diff.between(-0.3, -0.2), "Moderate").when(mean_diff.between(-0.2, 0.0), "Mild"))
