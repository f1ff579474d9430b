"""Streaming twins of the imagery check, the alert routing and the run state fold.

Every sink writes one folder per micro-batch in overwrite mode, so a repeated batch replaces its own
rows and nothing is written twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from landwatch.operators.checks import latest_completed, since_date
from landwatch.operators.lists import ALERT_LEVELS, alert_rows
from landwatch.streaming.run_fold import RUN_STATE, RunFold, thinned

c = F.col
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _start(df: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return (df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(save).start())


def candidate_runs(scenes: DataFrame, areas: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """Scenes that would start a run: on new days, under the area's cloud limit, not used by its last run.

    Works on a stream or a table of scenes; areas and runs are tables.
    """
    last = latest_completed(runs).select("aoi_id", "after_date", "before_scene_id", "after_scene_id")
    base = areas.select("aoi_id", "default_lookback_days", "max_cloud_cover").join(last, "aoi_id", "left").withColumn(
        "since", since_date(c("after_date"), now))
    day = c("acquired_at").cast("date")
    unused = ~(c("scene_id").eqNullSafe(c("before_scene_id")) | c("scene_id").eqNullSafe(c("after_scene_id")))
    hit = scenes.join(base, "aoi_id").where((day >= c("since")) & (day <= now.cast("date")) & (c("cloud_cover") < c("max_cloud_cover")) & unused)
    before = F.coalesce(c("after_date").cast("date"), F.date_sub(day, c("default_lookback_days")))
    return hit.select("aoi_id", "scene_id", "acquired_at", "cloud_cover", before.alias("before_day"), day.alias("after_day"))


def new_scene_job(scenes: DataFrame, areas: DataFrame, runs: DataFrame, now: Column, sink: str, checkpoint: str) -> StreamingQuery:
    """Scene stream to candidate runs; a scene announced again is dropped, however late, and none is lost for being late."""
    seen = scenes.withColumn("acquired_at", c("acquired_at").cast("timestamp"))
    return _start(candidate_runs(seen.dropDuplicates(["scene_id"]), areas, runs, now), sink, checkpoint)


def alert_job(events: DataFrame, sink: str, checkpoint: str, minimum: dict[str, int] | None = None) -> StreamingQuery:
    """Risk-event stream to alert rows per channel; an event seen again is dropped, however late, and none is lost for being late.

    Seen ids stay in state, hash-partitioned and spilled by the state store.
    """
    fresh = events.withColumn("created_at", c("created_at").cast("timestamp")).dropDuplicates(["risk_event_id"])
    return _start(alert_rows(fresh, minimum or ALERT_LEVELS), sink, checkpoint)


def run_state_job(log: DataFrame, sink: str, checkpoint: str, keep_ms: int | None = None) -> StreamingQuery:
    """Status-log stream (run_id, at, seq, status, before_scene_id) to the current state of each run.

    A batch reads its own rows and the keyed state of the runs it touches, never the log. Rows may come in any order and
    none is lost for being late: what is kept of a run (see ``run_fold.needed``) is all that any later row can
    make matter. Tasks drop needless rows before the shuffle, so a hot run sends a few rows a batch. ``keep_ms``, if
    given, forgets a run that was silent for so long; the default forgets nothing.
    """
    rows = log.select("run_id", F.unix_micros(c("at").cast("timestamp")).alias("at"), c("seq").cast("bigint").alias("seq"),
                      c("status").cast("int").alias("status"), "before_scene_id")
    folded = (rows.mapInPandas(thinned, rows.schema).groupBy("run_id")
              .transformWithStateInPandas(RunFold(keep_ms), RUN_STATE, "update", "ProcessingTime" if keep_ms else "None"))
    moment = lambda k: F.timestamp_micros(c(k)).alias(k)
    states = folded.select("run_id", "status", moment("started_at"), moment("completed_at"), "before_scene_id")
    conf, key = log.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key)
    conf.set(key, STATE_STORE)
    try:  # the query keeps the provider that it starts with
        return _start(states, f"{sink}/state", checkpoint, "update")
    finally:
        conf.set(key, before)


def newest_state(written: DataFrame) -> DataFrame:
    """Latest row of every run among the states written by all batches."""
    rest = [k for k in written.columns if k not in ("run_id", "batch")]
    best = F.max_by(F.struct(*rest), F.col("batch"))
    return written.groupBy("run_id").agg(best.alias("s")).select("run_id", "s.*")
