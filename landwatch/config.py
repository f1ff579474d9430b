"""Scoring thresholds and processing defaults."""

from __future__ import annotations

import copy
from dataclasses import dataclass
from typing import Any

# Default scoring thresholds, points, multipliers and reason codes.
DEFAULT_SCORING: dict[str, Any] = {
    "distance": {
        "max_points": 28,
        "thresholds": [
            {"distance_m": 100, "points": 28, "reason_code": "DISTANCE_LT_100M"},
            {"distance_m": 500, "points": 21, "reason_code": "DISTANCE_LT_500M"},
            {"distance_m": 1000, "points": 14, "reason_code": "DISTANCE_LT_1KM"},
            {"distance_m": 2500, "points": 7, "reason_code": "DISTANCE_LT_2.5KM"},
        ],
    },
    "ndvi_drop": {
        "max_points": 25,
        "thresholds": [
            {"delta": -0.5, "points": 25, "reason_code": "NDVI_DROP_SEVERE"},
            {"delta": -0.4, "points": 20, "reason_code": "NDVI_DROP_STRONG"},
            {"delta": -0.3, "points": 15, "reason_code": "NDVI_DROP_MODERATE"},
            {"delta": -0.2, "points": 10, "reason_code": "NDVI_DROP_MILD"},
        ],
    },
    "area": {
        "max_points": 15,
        "thresholds": [
            {"area_m2": 50000, "points": 15, "reason_code": "LARGE_AREA_GT_50000M2"},
            {"area_m2": 25000, "points": 11, "reason_code": "LARGE_AREA_GT_25000M2"},
            {"area_m2": 10000, "points": 8, "reason_code": "AREA_GT_10000M2"},
            {"area_m2": 5000, "points": 4, "reason_code": "AREA_GT_5000M2"},
        ],
    },
    "slope": {
        "max_points": 10,
        "thresholds": [
            {"slope_deg": 30, "points": 10, "reason_code": "SLOPE_GT_30DEG"},
            {"slope_deg": 20, "points": 7, "reason_code": "SLOPE_GT_20DEG"},
            {"slope_deg": 15, "points": 5, "reason_code": "SLOPE_GT_15DEG"},
            {"slope_deg": 10, "points": 3, "reason_code": "SLOPE_GT_10DEG"},
        ],
    },
    "directional_slope": {
        "max_points": 20,
        "upslope_threshold_m": 5.0,
        "downslope_threshold_m": -5.0,
        "upslope_multiplier_base": 1.5,
        "upslope_multiplier_max": 2.5,
        "upslope_elev_scale": 100,
        "downslope_multiplier_base": 0.9,
        "downslope_multiplier_min": 0.7,
        "downslope_elev_scale": 100,
    },
    "aspect": {
        "max_points": 5,
        "ranges": [
            {"min_deg": 157.5, "max_deg": 202.5, "points": 5, "reason_code": "ASPECT_SOUTH"},
            {"min_deg": 135, "max_deg": 157.5, "points": 4, "reason_code": "ASPECT_SE"},
            {"min_deg": 202.5, "max_deg": 225, "points": 4, "reason_code": "ASPECT_SW"},
            {"min_deg": 112.5, "max_deg": 135, "points": 2, "reason_code": "ASPECT_EAST"},
            {"min_deg": 225, "max_deg": 247.5, "points": 2, "reason_code": "ASPECT_WEST"},
            {"min_deg": 22.5, "max_deg": 67.5, "points": 1, "reason_code": "ASPECT_NE"},
            {"min_deg": 292.5, "max_deg": 337.5, "points": 1, "reason_code": "ASPECT_NW"},
            {"min_deg": 337.5, "max_deg": 360, "points": 0, "reason_code": "ASPECT_NORTH"},
            {"min_deg": 0, "max_deg": 22.5, "points": 0, "reason_code": "ASPECT_NORTH"},
        ],
    },
    "land_cover": {
        "multipliers": {
            "Forest": 1.0, "Residential": 0.9, "HerbaceousVegetation": 0.85, "River": 0.8,
            "PermanentCrop": 0.75, "Pasture": 0.7, "Industrial": 0.5, "SeaLake": 0.4,
            "AnnualCrop": 0.3, "Highway": 0.25,
        },
    },
    "landslide": {
        "multiplier": 1.8, "upslope_boost": 0.5, "min_slope_deg": 15.0, "max_multiplier": 2.5,
    },
    "criticality": {"max_points": 10, "multipliers": {0: 0.5, 1: 1.0, 2: 1.5, 3: 2.0}},
    "risk_levels": [
        {"name": "Low", "min_score": 0, "max_score": 24},
        {"name": "Medium", "min_score": 25, "max_score": 49},
        {"name": "High", "min_score": 50, "max_score": 74},
        {"name": "Critical", "min_score": 75, "max_score": 100},
    ],
}


def scoring_config(overrides: dict[str, Any] | None = None) -> dict[str, Any]:
    """Defaults with ``scoring_factors`` merged per known factor and ``risk_levels`` replaced.

    Works on a deep copy, so one caller's overrides never reach another caller.
    """
    config = copy.deepcopy(DEFAULT_SCORING)
    overrides = overrides or {}
    for factor, settings in (overrides.get("scoring_factors") or {}).items():
        if factor in config:
            config[factor].update(settings)
    if "risk_levels" in overrides:
        config["risk_levels"] = overrides["risk_levels"]
    return config


@dataclass(frozen=True)
class ProcessingConfig:
    """Processing defaults (fixed values)."""

    ndvi_threshold: float = -0.2
    min_area_m2: float = 2500.0
    max_distance_m: float = 500.0
    landslide_min_slope_deg: float = 10.0
    landslide_confidence: float = 0.5
    lidar_buffer_m: float = 100.0
    lidar_resolution_m: float = 1.0
    tile_size: int = 256
