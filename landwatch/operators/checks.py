"""Looking for new imagery over all areas at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landwatch.operators.ranking import first_by
from landwatch.schema import RUN_STATUSES

c = F.col
FALLBACK_DAYS = 30  # fixed value: look back this far when an area has no finished run
AT_WORK = [RUN_STATUSES[s] for s in ("Pending", "FetchingImagery", "CalculatingNdvi", "DetectingChanges", "ScoringRisk")]


def latest_completed(runs: DataFrame) -> DataFrame:
    """Newest completed run of every area, as an aggregate."""
    done = runs.where(c("status") == RUN_STATUSES["Completed"])
    return first_by(done, ["aoi_id"], [-F.unix_micros(c("created_at").cast("timestamp")), c("run_id")])


def idle_areas(areas: DataFrame, runs: DataFrame) -> DataFrame:
    """Areas without a run at work."""
    return areas.join(runs.where(c("status").isin(AT_WORK)), "aoi_id", "left_anti")


def since_date(after: Column, now: Column) -> Column:
    """Day after the last run's after date, else the fallback look-back."""
    return F.coalesce(F.date_add(after.cast("date"), 1), F.date_sub(now.cast("date"), FALLBACK_DAYS))


def check_areas(areas: DataFrame, runs: DataFrame, scenes: DataFrame, now: Column,
                max_cloud: float | None = None, since: str | None = None) -> DataFrame:
    """One row per area: whether there is a new scene, which one, and the dates to process.

    Scenes of the last completed run are removed with an anti join on (area, scene). A given
    ``since`` skips the last run, so nothing is removed and the before date comes from the look-back.
    """
    base = areas.select("aoi_id", "default_lookback_days", "max_cloud_cover")
    if since is None:
        last = latest_completed(runs).select("aoi_id", "after_date", "before_scene_id", "after_scene_id")
        base = base.join(last, "aoi_id", "left").withColumn("since_date", since_date(c("after_date"), now))
    else:
        base = base.withColumns({"after_date": F.lit(None).cast("timestamp_ntz"), "since_date": F.lit(since).cast("date")})
    limit = F.lit(float(max_cloud)) if max_cloud is not None else F.coalesce("max_cloud_cover", F.lit(20.0))
    found = (scenes.select("aoi_id", "scene_id", "acquired_at", "cloud_cover").join(base, "aoi_id")
             .where((c("acquired_at").cast("date") >= c("since_date")) & (c("acquired_at").cast("date") <= now.cast("date"))
                    & (c("cloud_cover") < limit)))
    if since is None:
        used = base.select("aoi_id", F.explode(F.array("before_scene_id", "after_scene_id")).alias("scene_id")).where(
            c("scene_id").isNotNull())
        found = found.join(used, ["aoi_id", "scene_id"], "left_anti")
    newest = first_by(found.select("aoi_id", "scene_id", "acquired_at", "cloud_cover"), ["aoi_id"],
                      [-F.unix_micros(c("acquired_at").cast("timestamp")), c("scene_id")])
    look_back = F.date_sub(c("acquired_at").cast("date"), F.coalesce("default_lookback_days", F.lit(90)))
    return base.join(newest, "aoi_id", "left").select(
        "aoi_id", c("scene_id").isNotNull().alias("new_data"), F.date_format("since_date", "yyyy-MM-dd").alias("since_date"),
        "scene_id", "cloud_cover",
        F.when(c("scene_id").isNotNull(), F.date_format(F.coalesce(c("after_date").cast("date"), look_back), "yyyy-MM-dd"))
        .alias("recommended_before_date"),
        F.date_format("acquired_at", "yyyy-MM-dd").alias("recommended_after_date"))


def scheduled_check(areas: DataFrame, runs: DataFrame, scenes: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(new pending runs, areas with last_checked_at and last_processed_at) of one scheduled check.

    Busy areas are only marked as checked. Run ids are digests of area and scene: a retry makes the same runs.
    """
    free = idle_areas(areas, runs)
    hits = check_areas(free, runs, scenes, now).where("new_data")
    made = hits.select(
        F.concat(F.lit("run-"), F.left(F.sha2(F.concat_ws("|", "aoi_id", "scene_id"), 256), F.lit(32))).alias("run_id"), "aoi_id",
        F.lit(RUN_STATUSES["Pending"]).alias("status"), c("recommended_before_date").cast("timestamp_ntz").alias("before_date"),
        c("recommended_after_date").cast("timestamp_ntz").alias("after_date"),
        F.create_map(F.lit("triggered_by"), F.lit("scheduled_check"), F.lit("scene_id"), c("scene_id"),
                     F.lit("cloud_cover"), c("cloud_cover").cast("string")).alias("metadata"))
    marked = (areas.join(made.select("aoi_id", F.lit(True).alias("_made")), "aoi_id", "left")
              .withColumns({"last_checked_at": now, "last_processed_at": F.when(c("_made"), now)}).drop("_made"))
    return made, marked


def unprocessed(scenes: DataFrame, runs: DataFrame) -> DataFrame:
    """Scenes no run has used on either side."""
    used = runs.select("aoi_id", F.explode(F.array("before_scene_id", "after_scene_id")).alias("scene_id")).distinct()
    return scenes.join(used, ["aoi_id", "scene_id"], "left_anti")


def monitoring_chain(scenes: DataFrame, lookback_days: Column) -> DataFrame:
    """Days with a scene per area, each with the before date a run on it would use.

    A day's before date is the scene day before it; the first day of an area looks back.
    """
    from landwatch.operators.state import split_lag
    days = (scenes.groupBy("aoi_id", c("acquired_at").cast("date").alias("after_day"))
            .agg(F.max("acquired_at").alias("newest_at")))
    chained = split_lag(days, ["aoi_id"], ["after_day"], "after_day", F.trunc("after_day", "year"), "previous_day")
    return chained.withColumn("before_day", F.coalesce("previous_day", F.date_sub("after_day", lookback_days)))
