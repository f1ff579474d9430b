"""Record state as folds of change logs over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landwatch.schema import RUN_STATUSES

c = F.col


def split_lag(df: DataFrame, keys: list[str], order: list[str], value: str, part: Column, out: str) -> DataFrame:
    """Previous value per key in order, with each key's rows cut into parts that ``order`` sorts.

    Only the last value of each part is carried over, so a hot key is spread over its parts.
    """
    cut = df.withColumn("_part", part)
    ends = cut.groupBy(*keys, "_part").agg(F.max_by(F.struct(c(value)), F.struct(*order)).alias("_end"))
    across = Window.partitionBy(*keys).orderBy("_part")
    ends = ends.withColumn("_before", F.lag("_end").over(across)).drop("_end")
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    return (cut.withColumn("_in", F.lag(F.struct(c(value))).over(inside))
            .join(ends, [*keys, "_part"], "left")
            .withColumn(out, F.coalesce("_in", "_before")[value]).drop("_in", "_before", "_part"))


def run_state(log: DataFrame, order: list[str], part: Column) -> DataFrame:
    """Current state of every run from its status log.

    The log has run_id, at, status and optionally before_scene_id, after_scene_id and error_message.
    A run starts when it first fetches imagery and is completed at its last change into Completed or
    Failed; empty texts never overwrite.
    """
    start, done = RUN_STATUSES["FetchingImagery"], [RUN_STATUSES["Completed"], RUN_STATUSES["Failed"]]
    steps = split_lag(log, ["run_id"], order, "status", part, "_was")
    moved = c("status") != F.coalesce("_was", F.lit(RUN_STATUSES["Pending"]))
    at = F.struct(*order)
    texts = [k for k in ("before_scene_id", "after_scene_id", "error_message") if k in log.columns]
    filled = lambda k: F.coalesce(c(k) != "", F.lit(False))
    return steps.groupBy("run_id").agg(
        F.max_by("status", at).alias("status"),
        F.min(F.when(moved & (c("status") == start), c("at"))).alias("started_at"),
        F.max(F.when(moved & c("status").isin(done), c("at"))).alias("completed_at"),
        *[F.max_by(F.when(filled(k), c(k)), F.when(filled(k), at)).alias(k) for k in texts])


def merge_metadata(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One metadata map per key; of equal entries the newest wins.

    Entries are reduced per (key, name) before the maps are built, so the map holds names, not log rows.
    """
    rows = log.select(*keys, *order, F.explode("metadata").alias("k", "v"))
    newest = rows.groupBy(*keys, "k").agg(F.max_by("v", F.struct(*order)).alias("v"))
    return newest.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("metadata"))


def overlay(old: Column, new: Column) -> Column:
    """Old map with the new entries written over it."""
    base = F.coalesce(old, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    keep = F.map_filter(base, lambda k, v: ~F.map_contains_key(new, k))
    return F.when(new.isNull(), old).otherwise(F.map_concat(keep, new))


def apply_once(events: DataFrame, log: DataFrame, kind: str, note_key: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """First action per event wins; later ones, and ones on unknown events, come back with an error.

    ``kind`` names the columns <kind>_at and <kind>_by; log rows carry risk_event_id, at, actor and note.
    The note goes into the notes map of the event.
    """
    at, by = f"{kind}_at", f"{kind}_by"
    pos = F.struct(*order)
    first = log.groupBy("risk_event_id").agg(
        F.min(pos).alias("_first"), F.min_by(F.struct("at", "actor", "note"), pos).alias("_act"))
    free = c(at).isNull() & c("_act").isNotNull()
    note = F.when(free & F.coalesce(c("_act.note") != "", F.lit(False)),
                  F.create_map(F.lit(note_key), c("_act.note")))
    updated = (events.join(first.drop("_first"), "risk_event_id", "left")
               .withColumns({"_note": note, "_free": free})
               .withColumn("notes", overlay(c("notes"), c("_note")))
               .withColumns({at: F.when(c("_free"), c("_act.at")).otherwise(c(at)),
                             by: F.when(c("_free"), c("_act.actor")).otherwise(c(by))})
               .drop("_act", "_note", "_free"))
    known = events.select("risk_event_id", c(at).isNotNull().alias("_done"))
    error = (F.when(c("_done").isNull(), "not found").when(c("_done") | (pos != c("_first")), f"already {kind}"))
    rejected = (log.join(known, "risk_event_id", "left").join(first.select("risk_event_id", "_first"), "risk_event_id", "left")
                .withColumn("error", error).where(c("error").isNotNull()).drop("_done", "_first"))
    return updated, rejected


def update_schedules(areas: DataFrame, requests: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Apply schedule requests field by field; out-of-range or unknown ones come back with an error.

    Null leaves a field alone and an empty schedule clears it; of several requests the last set value wins.
    """
    known = areas.select("aoi_id").withColumn("_known", F.lit(True))
    cloud, days = c("max_cloud_cover"), c("default_lookback_days")
    error = (F.when(c("_known").isNull(), "not found")
             .when(~cloud.between(1, 100), "MaxCloudCover must be between 1 and 100")
             .when(~days.between(1, 365), "DefaultLookbackDays must be between 1 and 365"))
    checked = requests.join(known, "aoi_id", "left").withColumn("error", error).drop("_known")
    at = F.struct(*order)
    fields = ["processing_schedule", "processing_enabled", "default_lookback_days", "max_cloud_cover"]
    last = checked.where(c("error").isNull()).groupBy("aoi_id").agg(
        *[F.max_by(c(k), F.when(c(k).isNotNull(), at)).alias(f"_{k}") for k in fields])
    out = areas.join(last, "aoi_id", "left")
    for k in fields:
        value = F.coalesce(f"_{k}", k)
        out = out.withColumn(k, F.nullif(value, F.lit("")) if k == "processing_schedule" else value)
    return out.drop(*[f"_{k}" for k in fields]), checked.where(c("error").isNotNull())


def delete_runs(runs: DataFrame, changes: DataFrame, events: DataFrame, doomed: DataFrame) -> dict[str, DataFrame]:
    """Runs, changes and events that remain when runs go with everything below them."""
    ids = doomed.select("run_id").distinct()
    gone = changes.join(ids, "run_id", "left_semi").select("change_id")
    return {"runs": runs.join(ids, "run_id", "left_anti"), "changes": changes.join(ids, "run_id", "left_anti"),
            "risk_events": events.join(gone, "change_id", "left_anti")}


def delete_assets(assets: DataFrame, aoi_id: str, asset_type: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(remaining assets, number deleted)."""
    doomed = c("aoi_id") == aoi_id
    doomed = doomed if asset_type is None else doomed & (c("asset_type") == asset_type)
    return assets.where(~doomed), assets.agg(F.count_if(doomed).alias("deleted"))
