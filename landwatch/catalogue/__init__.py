"""Named queries over the driver's tables, one or more per operator family."""

from importlib import import_module

from landwatch.catalogue.registry import _ORACLES, _QUERIES

MODULES = ["scoring", "lists", "plans", "catalog", "rasters", "models", "ingest", "flows", "stored"]

for _m in MODULES:
    import_module(f"landwatch.catalogue.{_m}")


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_ORACLES)
