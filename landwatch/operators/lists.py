"""Lists, counts and triage over stored events, assets, runs and changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landwatch.operators import ranking
from landwatch.schema import ASSET_TYPES, RISK_LEVELS, RUN_STATUSES, name_of

c = F.col


def with_run(events: DataFrame, changes: DataFrame, runs: DataFrame) -> DataFrame:
    """Events with run_id and aoi_id of their change."""
    path = changes.select("change_id", "run_id").join(runs.select("run_id", "aoi_id"), "run_id", "left")
    return events.join(path, "change_id", "left")


def list_events(events: DataFrame, aoi_id=None, min_score=None, level=None, asset_id=None, run_id=None,
                acknowledged=None, dismissed=False) -> DataFrame:
    """Stored events under optional tests; dismissed ones are hidden unless asked for."""
    tests = {
        "aoi_id": aoi_id is not None and c("aoi_id") == aoi_id,
        "score": min_score is not None and c("risk_score") >= min_score,
        "level": level is not None and c("risk_level") == level,
        "asset": asset_id is not None and c("asset_id") == asset_id,
        "run": run_id is not None and c("run_id") == run_id,
        "ack": acknowledged is not None and (c("acknowledged_at").isNotNull() if acknowledged else c("acknowledged_at").isNull()),
        "dis": dismissed is not None and (c("dismissed_at").isNotNull() if dismissed else c("dismissed_at").isNull()),
    }
    for test in tests.values():
        events = events if test is False else events.where(test)
    return events


def page(df: DataFrame, order: list[Column], key: str, limit: int, offset: int = 0, near: int = 10_000) -> DataFrame:
    """One page in a repeatable order, ``key`` deciding between equals.

    A page that ends within ``near`` rows is a top-k; a deeper one is found by the row counts of ranges,
    so that no task sorts the rows before it.
    """
    order = [*order, c(key)]
    if offset + limit > near:
        return ranking.rows_between(df, order, offset + 1, offset + limit)
    df = df.orderBy(*order)
    return (df.offset(offset) if offset else df).limit(limit)


def list_assets(assets: DataFrame, aoi_id=None, asset_type=None, criticality=None, skip=0, take=100) -> DataFrame:
    """A page of ``take`` assets by id."""
    for name, value in (("aoi_id", aoi_id), ("asset_type", asset_type), ("criticality", criticality)):
        assets = assets if value is None else assets.where(c(name) == value)
    return page(assets, [], "asset_id", take, skip)


def unacknowledged(events: DataFrame, min_level: int | None = None) -> DataFrame:
    """Events nobody has acknowledged; dismissed ones stay in."""
    events = events.where(c("acknowledged_at").isNull())
    return events if min_level is None else events.where(c("risk_level") >= min_level)


def event_summary(events: DataFrame, assets: DataFrame) -> DataFrame:
    """Display columns of events: names with "Unknown" defaults and flags from null tests."""
    names = assets.select("asset_id", c("name").alias("asset_name"), "asset_type")
    return events.join(names, "asset_id", "left").select(
        "risk_event_id", "change_id", "asset_id",
        F.coalesce("asset_name", F.lit("Unknown")).alias("asset_name"),
        F.coalesce(name_of(ASSET_TYPES, c("asset_type")), F.lit("Unknown")).alias("asset_type_name"),
        "distance_meters", "risk_score", "risk_level", name_of(RISK_LEVELS, c("risk_level")).alias("risk_level_name"),
        c("acknowledged_at").isNotNull().alias("is_acknowledged"), c("dismissed_at").isNotNull().alias("is_dismissed"),
        "created_at")


def triage(summary: DataFrame, in_result: DataFrame | None = None, min_score: int = 0, level_name: str | None = None,
           asset_type_name: str | None = None, show_acknowledged: bool = True) -> DataFrame:
    """What a reviewer sees: in the query result, not dismissed, over the score, of the level and type."""
    df = summary if in_result is None else summary.join(in_result.select("risk_event_id"), "risk_event_id", "left_semi")
    df = df.where(~c("is_dismissed") & (c("risk_score") >= min_score))
    if level_name is not None:
        df = df.where(c("risk_level_name") == level_name)
    if asset_type_name is not None:
        df = df.where(c("asset_type_name") == asset_type_name)
    return df if show_acknowledged else df.where(~c("is_acknowledged"))


def high_priority(events: DataFrame) -> DataFrame:
    return events.where(c("risk_level").isin(RISK_LEVELS["High"], RISK_LEVELS["Critical"]))


def alert_rows(events: DataFrame, minimum: dict[str, int]) -> DataFrame:
    """One row per event and channel whose minimum level the event reaches, with its JSON payload."""
    channels = F.array(*[F.struct(F.lit(n).alias("channel"), F.lit(m).alias("min_level")) for n, m in minimum.items()])
    fired = F.filter(channels, lambda ch: c("risk_level") >= ch["min_level"])
    body = F.to_json(F.struct(
        c("risk_event_id").alias("riskEventId"), c("asset_id").alias("assetId"), c("risk_score").alias("riskScore"),
        name_of(RISK_LEVELS, c("risk_level")).alias("riskLevel"), c("distance_meters").alias("distanceMeters"), c("created_at").alias("createdAt")))
    return (events.withColumn("_ch", F.explode(fired))
            .select("risk_event_id", c("_ch.channel").alias("channel"), "risk_level", body.alias("payload")))


ALERT_LEVELS = {"webhook": RISK_LEVELS["Critical"], "email": RISK_LEVELS["High"]}  # fixed values


def area_statistics(events: DataFrame) -> DataFrame:
    """Totals, unacknowledged and per-level counts of every area, in one pass over the events."""
    levels = [F.count_if(c("risk_level") == code).alias(f"{name.lower()}_events") for name, code in RISK_LEVELS.items()]
    return events.groupBy("aoi_id").agg(
        F.count("*").alias("total_events"), F.count_if(c("acknowledged_at").isNull()).alias("unacknowledged_events"), *levels)


def level_map(stats: DataFrame) -> DataFrame:
    """Per-level counts as one map, levels without events left out."""
    entries = F.array(*[F.struct(F.lit(n).alias("level"), c(f"{n.lower()}_events").alias("n")) for n in RISK_LEVELS])
    used = F.filter(entries, lambda e: e["n"] > 0)
    return stats.withColumn("by_risk_level", F.map_from_entries(used))


def counted(parents: DataFrame, children: DataFrame, key: str, out: str) -> DataFrame:
    """Parents with the number of their children, 0 when there are none."""
    n = children.groupBy(key).agg(F.count("*").alias(out))
    return parents.join(n, key, "left").withColumn(out, F.coalesce(out, F.lit(0)).cast("long"))


def run_counts(runs: DataFrame, changes: DataFrame, events: DataFrame) -> DataFrame:
    """Runs with their numbers of changes and of events on those changes."""
    per_change = events.groupBy("change_id").agg(F.count("*").alias("_e"))
    per_run = (changes.select("run_id", "change_id").join(per_change, "change_id", "left").groupBy("run_id")
               .agg(F.count("*").alias("change_count"), F.coalesce(F.sum("_e"), F.lit(0)).alias("event_count")))
    return runs.join(per_run, "run_id", "left").withColumns({
        "change_count": F.coalesce("change_count", F.lit(0)).cast("long"),
        "event_count": F.coalesce("event_count", F.lit(0)).cast("long")})


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table name."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = one if out is None else out.unionByName(one)
    return out


def run_progress(runs: DataFrame) -> DataFrame:
    """Step number of each run, which of the steps lie behind it, and whether it is at work."""
    steps = [s for s in RUN_STATUSES if s != "Failed"]
    name = name_of(RUN_STATUSES, c("status"))
    now = F.array_position(F.array(*[F.lit(s) for s in steps]), name).cast("int") - 1
    state = lambda i: F.when(F.lit(i) < now, "completed").when(F.lit(i) == now, "active").otherwise("pending")
    return runs.withColumns({
        "status_name": name, "step_index": now, "in_progress": ~name.isin("Completed", "Failed", "Pending"),
        **{f"step_{s.lower()}": state(i) for i, s in enumerate(steps)}})


def run_summary(changes: DataFrame, events: DataFrame) -> DataFrame:
    """Per run: polygons, events, whether land cover is known anywhere, and a model version.

    The version is the smallest non-null one, so the answer does not depend on row order.
    """
    per_change = events.groupBy("change_id").agg(F.count("*").alias("_e"))
    return changes.join(per_change, "change_id", "left").groupBy("run_id").agg(
        F.count("*").alias("polygon_count"), F.coalesce(F.sum("_e"), F.lit(0)).alias("risk_event_count"),
        F.bool_or(c("land_cover_class").isNotNull()).alias("has_land_cover"),
        F.min("ml_model_version").alias("ml_model_version"))
