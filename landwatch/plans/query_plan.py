"""Structured query plans: what to look for, where, when, in which order and how many."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

ENTITIES = ("RiskEvent", "ChangePolygon", "Asset", "ProcessingRun")
OPERATORS = ("eq", "neq", "gt", "gte", "lt", "lte", "in")


def lenient_text(value: Any) -> str:
    """Filter values arrive as text, number, flag or list; lists are joined by commas."""
    if isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return str(int(value)) if float(value).is_integer() else repr(float(value))
    if isinstance(value, list):
        plain = lambda v: isinstance(v, (str, int, float)) and not isinstance(v, bool)
        return ",".join(lenient_text(v) if plain(v) else "" for v in value)
    return ""


@dataclass
class AttributeFilter:
    property: str = ""
    operator: str = "eq"
    value: str = ""


@dataclass
class SpatialFilter:
    operation: str = "within_distance"
    reference_entity_type: str = "Asset"
    reference_filters: list[AttributeFilter] = field(default_factory=list)
    distance_meters: float | None = None


@dataclass
class DateRange:
    property: str = "CreatedAt"
    start: datetime | None = None
    end: datetime | None = None


@dataclass
class QueryPlan:
    target_entity: str = "RiskEvent"
    filters: list[AttributeFilter] = field(default_factory=list)
    spatial_filter: SpatialFilter | None = None
    date_range: DateRange | None = None
    aoi_id: str | None = None
    order_by: str | None = None
    order_descending: bool = True
    limit: int | None = None


def _when(text: str | None) -> datetime | None:
    return datetime.fromisoformat(text.replace("Z", "+00:00")).replace(tzinfo=None) if text else None


def _filters(rows: list[dict] | None) -> list[AttributeFilter]:
    return [AttributeFilter(r.get("property", ""), r.get("operator", "eq"), lenient_text(r.get("value", "")))
            for r in rows or []]


def load_plan(source: str | dict[str, Any]) -> QueryPlan:
    """Plan of a JSON text or a dictionary, with camel-case keys in any letter case."""
    raw = json.loads(source) if isinstance(source, str) else source

    def lowered(node):
        if isinstance(node, dict):
            return {k.lower(): lowered(v) for k, v in node.items()}
        return [lowered(v) for v in node] if isinstance(node, list) else node

    d = lowered(raw)
    entity = d.get("targetentity", "RiskEvent")
    named = next((e for e in ENTITIES if e.lower() == str(entity).lower()), None)
    if named is None:
        raise ValueError(f"unknown target entity {entity!r}")
    s, r = d.get("spatialfilter"), d.get("daterange")
    return QueryPlan(
        target_entity=named, filters=_filters(d.get("filters")),
        spatial_filter=s and SpatialFilter(
            s.get("operation", "within_distance"), s.get("referenceentitytype", "RiskEvent"),
            _filters(s.get("referencefilters")), s.get("distancemeters")),
        date_range=r and DateRange(r.get("property", "CreatedAt"), _when(r.get("from")), _when(r.get("to"))),
        aoi_id=d.get("aoiid") or None, order_by=d.get("orderby"),
        order_descending=d.get("orderdescending", True), limit=d.get("limit"))


def as_int(text: str) -> int | None:
    """Whole number, or None for anything else (decimals included)."""
    return int(text) if re.fullmatch(r"\s*[+-]?\d+\s*", text) else None


def as_float(text: str) -> float | None:
    """Decimal number with optional thousands commas and exponent, or None."""
    bare = text.strip().replace(",", "")
    return float(bare) if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", bare) else None
