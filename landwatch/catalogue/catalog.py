"""Scene catalog, imagery checks, bulk loads and state folds."""

from pyspark.sql import functions as F

from landwatch.catalogue.registry import query
from landwatch.functions import geometry as G
from landwatch.operators import checks as K
from landwatch.operators import loads, state
from landwatch.sources import scenes as S

c = F.col
NOW = "2024-01-20 12:00:00"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def scene_items(t):
    """Catalog items as JSON texts, as a catalog would send them."""
    text = F.to_json(F.struct(
        c("scene_id").alias("id"), F.array(*[F.lit(v) for v in (-121.7, 39.7, -121.55, 39.76)]).alias("bbox"),
        F.struct(F.date_format("acquired_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("datetime"),
                 F.when(c("cloud_cover") >= 5, c("cloud_cover")).alias("eo:cloud_cover"), c("platform").alias("platform")).alias("properties"),
        F.create_map(*[v for b in ("B04", "B08", "thumbnail") for v in (
            F.lit(b), F.struct(F.concat(F.lit("s3://x/"), c("scene_id"), F.lit(f"/{b}.tif")).alias("href"), F.lit("image/tiff").alias("type")))]).alias("assets")))
    return t.scenes.select(text.alias("item_text"))


@query("scenes", """SELECT scene_id, date_trunc('second', acquired_at) AS acquired_at, CASE WHEN cloud_cover >= 5 THEN cloud_cover ELSE 0.0::DOUBLE END AS cloud_cover,
concat('s3://x/', scene_id, '/B04.tif') AS red_url, NULL::VARCHAR AS coastal_url, 2 AS band_count, -121.7::DOUBLE AS min_lon FROM scenes""")
def scene_catalog(t):
    """Scenes read from item texts: known bands, cloud 0 when absent, missing bands null."""
    rows = S.parse_items(scene_items(t), "item_text")
    return rows.select("scene_id", c("acquired_at").cast("timestamp_ntz").alias("acquired_at"), "cloud_cover",
                       S.band_url(c("bands"), "B04").alias("red_url"), S.band_url(c("bands"), "B01").alias("coastal_url"),
                       F.size("bands").alias("band_count"), "min_lon")


@query("scenes", """SELECT scene_id, aoi_id, acquired_at, cloud_cover FROM scenes WHERE acquired_at >= TIMESTAMP '2024-01-03' AND acquired_at < TIMESTAMP '2024-01-13'
AND cloud_cover < 15""")
def scene_search(t):
    return S.search(t.scenes, "2024-01-03", "2024-01-12", 15.0).select("scene_id", "aoi_id", "acquired_at", "cloud_cover")


@query("scenes", """SELECT scene_id, aoi_id, cloud_cover FROM scenes WHERE scene_id = 'scene-123'""")
def scene_by_id(t):
    return S.scene_by_id(t.scenes, "scene-123").select("scene_id", "aoi_id", "cloud_cover")


BEST = """tg AS (SELECT aoi_id, TIMESTAMP '{0}' AS target_at FROM aois),
w{1} AS (SELECT s.*, target_at FROM scenes s JOIN tg{1} USING (aoi_id)
 WHERE acquired_at >= target_at::DATE - 3 AND acquired_at < target_at::DATE + 4 AND cloud_cover < 20),
d{1} AS (SELECT *, CAST(abs(floor((epoch_us(acquired_at) - epoch_us(target_at)) / 86400000000.0)) AS INT) AS days_off FROM w{1}),
b{1} AS (SELECT *, row_number() OVER (PARTITION BY aoi_id ORDER BY days_off, cloud_cover, acquired_at DESC, scene_id) AS k FROM d{1})"""


def _best(at, tag):
    return BEST.format(at, tag).replace("tg AS", f"tg{tag} AS", 1)


@query("aois scenes", f"WITH {_best('2024-01-05', 1)} SELECT aoi_id, scene_id, acquired_at, cloud_cover, days_off FROM b1 WHERE k = 1")
def best_scene_per_area(t):
    """Scene closest to a target day with the least cloud."""
    tg = t.aois.select("aoi_id", F.lit("2024-01-05").cast("timestamp_ntz").alias("target_at"))
    return S.best_scenes(t.scenes, tg, 3).select("aoi_id", "scene_id", "acquired_at", "cloud_cover", "days_off")


@query("aois scenes", f"""WITH {_best('2024-01-05', 1)}, {_best('2024-01-12', 2)}
SELECT coalesce(x.aoi_id, y.aoi_id) AS aoi_id, x.scene_id AS before_scene_id, y.scene_id AS after_scene_id, x.scene_id IS NOT NULL AND y.scene_id IS NOT NULL AS complete
FROM (SELECT * FROM b1 WHERE k = 1) x FULL JOIN (SELECT * FROM b2 WHERE k = 1 AND aoi_id <> 'aoi-9') y ON x.aoi_id = y.aoi_id""")
def scene_pairs(t):
    """Before and after scene per area."""
    tg = t.aois.select("aoi_id", F.lit("2024-01-05").cast("timestamp_ntz").alias("before_at"),
                       F.lit("2024-01-12").cast("timestamp_ntz").alias("after_at"))
    return S.scene_pairs(t.scenes, tg, 3).select("aoi_id", "before_scene_id", "after_scene_id", "complete")


LATEST = """lr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY aoi_id ORDER BY created_at DESC, run_id) AS k FROM scene_runs WHERE status = 5) WHERE k = 1)"""
CHECK = f"""{LATEST}, base AS (SELECT a.aoi_id, a.default_lookback_days, a.max_cloud_cover, lr.after_date, lr.before_scene_id, lr.after_scene_id,
 coalesce(lr.after_date::DATE + 1, DATE '2024-01-20' - 30)::DATE AS since FROM aois a LEFT JOIN lr ON a.aoi_id = lr.aoi_id),
fs AS (SELECT b.*, s.scene_id, s.acquired_at, s.cloud_cover, row_number() OVER (PARTITION BY b.aoi_id ORDER BY acquired_at DESC, scene_id) AS k
 FROM base b JOIN scenes s ON s.aoi_id = b.aoi_id AND s.acquired_at::DATE >= since AND s.acquired_at::DATE <= DATE '2024-01-20' AND s.cloud_cover < b.max_cloud_cover
 AND s.scene_id IS DISTINCT FROM b.before_scene_id AND s.scene_id IS DISTINCT FROM b.after_scene_id),
ck AS (SELECT b.aoi_id, f.scene_id IS NOT NULL AS new_data, strftime(b.since, '%Y-%m-%d') AS since_date, f.scene_id, f.cloud_cover,
 CASE WHEN f.scene_id IS NOT NULL THEN strftime(coalesce(b.after_date::DATE, f.acquired_at::DATE - b.default_lookback_days)::DATE, '%Y-%m-%d') END AS recommended_before_date,
 strftime(f.acquired_at, '%Y-%m-%d') AS recommended_after_date FROM base b LEFT JOIN (SELECT * FROM fs WHERE k = 1) f ON b.aoi_id = f.aoi_id)"""


@query("scene_runs", f"WITH {LATEST} SELECT aoi_id, run_id, after_date, after_scene_id FROM lr")
def latest_completed_runs(t):
    return K.latest_completed(t.scene_runs).select("aoi_id", "run_id", "after_date", "after_scene_id")


@query("aois scene_runs scenes", f"WITH {CHECK} SELECT * FROM ck")
def imagery_check(t):
    """New imagery per area since its last completed run."""
    return K.check_areas(t.aois, t.scene_runs, t.scenes, now())


@query("aois scene_runs scenes", """WITH n AS (SELECT a.*, s.scene_id, s.acquired_at, s.cloud_cover, row_number() OVER (PARTITION BY a.aoi_id ORDER BY acquired_at DESC, scene_id) AS k
FROM aois a JOIN scenes s ON s.aoi_id = a.aoi_id AND s.acquired_at::DATE >= DATE '2024-01-02' AND s.acquired_at::DATE <= DATE '2024-01-20' AND s.cloud_cover < 40)
SELECT aoi_id, true AS new_data, '2024-01-02' AS since_date, scene_id, cloud_cover, strftime((acquired_at::DATE - 90)::DATE, '%Y-%m-%d') AS recommended_before_date,
strftime(acquired_at, '%Y-%m-%d') AS recommended_after_date FROM n WHERE k = 1""")
def imagery_check_since(t):
    """Check from a given day and cloud limit, without regard to earlier runs."""
    return K.check_areas(t.aois, t.scene_runs, t.scenes, now(), max_cloud=40.0, since="2024-01-02")


@query("aois scene_runs scenes", f"""WITH {CHECK} SELECT aoi_id, status, before_date, after_date, scene_id FROM (SELECT aoi_id, 0 AS status, recommended_before_date::TIMESTAMP AS before_date,
recommended_after_date::TIMESTAMP AS after_date, scene_id FROM ck WHERE new_data AND aoi_id NOT IN (SELECT aoi_id FROM scene_runs WHERE status < 5))""")
def scheduled_runs(t):
    """Runs a scheduled check creates for idle areas."""
    made, _ = K.scheduled_check(t.aois, t.scene_runs, t.scenes, now())
    return made.select("aoi_id", "status", "before_date", "after_date", c("metadata")["scene_id"].alias("scene_id"))


@query("aois scene_runs scenes", f"""WITH {CHECK} SELECT aoi_id, TIMESTAMP '{NOW}' AS last_checked_at, CASE WHEN new_data AND
aoi_id NOT IN (SELECT aoi_id FROM scene_runs WHERE status < 5) THEN TIMESTAMP '{NOW}' END AS last_processed_at FROM ck""")
def areas_checked(t):
    """Areas after a scheduled check: all are marked checked, those with a new run processed."""
    _, marked = K.scheduled_check(t.aois, t.scene_runs, t.scenes, now())
    return marked.select("aoi_id", "last_checked_at", "last_processed_at")


@query("scenes scene_runs", """SELECT aoi_id, count(*) AS scene_count, max(acquired_at) AS newest_at FROM scenes s WHERE NOT EXISTS
(SELECT 1 FROM scene_runs r WHERE r.aoi_id = s.aoi_id AND (r.before_scene_id = s.scene_id OR r.after_scene_id = s.scene_id)) GROUP BY aoi_id""")
def unprocessed_scenes(t):
    """Scenes no run has used: how many per area, and the newest."""
    return K.unprocessed(t.scenes, t.scene_runs).groupBy("aoi_id").agg(
        F.count("*").alias("scene_count"), F.max("acquired_at").alias("newest_at"))


@query("scenes", """SELECT aoi_id, strftime(after_day, '%Y-%m-%d') AS after_day, strftime(coalesce(lag(after_day) OVER (PARTITION BY aoi_id ORDER BY after_day),
after_day - 90)::DATE, '%Y-%m-%d') AS before_day FROM (SELECT DISTINCT aoi_id, acquired_at::DATE AS after_day FROM scenes)""")
def monitoring_chain(t):
    """Before and after day of successive runs per area."""
    m = K.monitoring_chain(t.scenes, F.lit(90))
    return m.select("aoi_id", F.date_format("after_day", "yyyy-MM-dd").alias("after_day"), F.date_format("before_day", "yyyy-MM-dd").alias("before_day"))


# --- loads -------------------------------------------------------------------

BATCH = """eb AS (SELECT concat(l_orderkey, '-', l_partkey, '-', l_suppkey, '-', l_linenumber) AS risk_event_id,
 CASE WHEN l_linenumber = 7 THEN NULL ELSE concat('chg-', l_orderkey + CASE WHEN l_suppkey % 10 = 3 THEN 100000000 ELSE 0 END) END AS change_id,
 concat('asset-', l_partkey) AS asset_id FROM lineitem)"""


def event_batch(t):
    return t.lineitem.select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("risk_event_id"),
        F.when(c("l_linenumber") != 7, F.concat(F.lit("chg-"), c("l_orderkey") + F.when(c("l_suppkey") % 10 == 3, 100000000).otherwise(0))).alias("change_id"),
        F.concat(F.lit("asset-"), "l_partkey").alias("asset_id"))


@query("assets changes", f"""WITH {BATCH}, ch AS (SELECT b.*, CASE WHEN b.change_id IS NULL THEN 'Missing change polygon ID'
WHEN b.change_id NOT IN (SELECT change_id FROM changes) THEN 'Change polygon not found'
WHEN b.asset_id NOT IN (SELECT asset_id FROM assets) THEN 'Asset not found' END AS error FROM eb b)
SELECT error, count(*) AS rows FROM ch GROUP BY error""")
def event_load_outcome(t):
    """Bulk load of events: accepted rows and rejected rows by reason."""
    return loads.outcome(*loads.load_events(event_batch(t), t.changes, t.assets))


@query("changes runs", """WITH b AS (SELECT change_id, CASE WHEN half_size_deg < 0.00025 THEN concat('no-', run_id) ELSE run_id END AS run_id, lon, lat, half_size_deg,
CASE WHEN half_size_deg BETWEEN 0.00025 AND 0.00035 THEN NULL WHEN half_size_deg BETWEEN 0.00035 AND 0.00045 THEN 'Point' WHEN half_size_deg > 0.00065 THEN 'MultiPolygon' ELSE 'Polygon' END AS kind FROM changes)
SELECT change_id, round(CASE WHEN kind = 'MultiPolygon' THEN lon + 0.01 ELSE lon END - half_size_deg, 7) AS min_lon, CASE WHEN run_id NOT IN (SELECT run_id FROM runs) THEN 'Processing run not found'
WHEN kind IS NULL THEN 'Geometry is null in request' WHEN kind = 'Point' THEN 'Geometry must be a Polygon or MultiPolygon, got Point' END AS error FROM b""")
def change_load(t):
    """Bulk load of changes: unknown runs, missing and unfit geometries rejected, largest member kept."""
    h, x, y = c("half_size_deg"), c("lon"), c("lat")
    small = lambda k: G.box(x - h * k, y - h * k, x + h * k, y + h * k)["parts"]
    big = G.box(x + 0.01 - h, y - h, x + 0.01 + h, y + h)["parts"]
    geom = (F.when(h.between(0.00025, 0.00035), None).when(h.between(0.00035, 0.00045), G.point(x, y))
            .when(h > 0.00065, G.geometry("MultiPolygon", F.concat(small(0.5), big, small(0.9)))).otherwise(G.box(x - h, y - h, x + h, y + h)))
    batch = t.changes.select("change_id", "lon", "half_size_deg", geom.alias("geometry"),
                             F.when(h < 0.00025, F.concat(F.lit("no-"), "run_id")).otherwise(c("run_id")).alias("run_id"))
    good, bad = loads.load_changes(batch, t.runs)
    row = good.select("change_id", F.round(G.bounds(c("geometry"))[0], 7).alias("min_lon"), F.lit(None).cast("string").alias("error"))
    gone = bad.select("change_id", F.round(F.when(h > 0.00065, x + 0.01).otherwise(x) - h, 7).alias("min_lon"), "error")
    return row.unionByName(gone)


@query("assets aois", """WITH b AS (SELECT c_custkey AS seq, concat('asset-', c_custkey * 3 % 4000) AS asset_id, CASE WHEN c_custkey % 50 = 0 THEN 'aoi-none' ELSE concat('aoi-', c_custkey * 3 % 4000 % 5) END AS aoi_id,
CASE WHEN c_custkey % 11 = 0 THEN 200.0 ELSE -121.0 END AS lon FROM customer UNION ALL SELECT 1000000 + c_custkey, concat('asset-', c_custkey * 6 % 4000), concat('aoi-', c_custkey * 6 % 4000 % 5), -121.0 FROM customer WHERE c_custkey % 2 = 0),
m AS (SELECT b.*, EXISTS (SELECT 1 FROM assets a WHERE a.asset_id = b.asset_id AND a.aoi_id = b.aoi_id) AS old FROM b),
f AS (SELECT *, min(CASE WHEN NOT old AND lon < 180 AND aoi_id <> 'aoi-none' THEN seq END) OVER (PARTITION BY aoi_id, asset_id) AS first FROM m)
SELECT CASE WHEN aoi_id = 'aoi-none' THEN 'Area of Interest not found' WHEN old OR first < seq THEN 'Asset already exists' WHEN lon > 180 THEN 'Invalid geometry' END AS error, count(*) AS rows FROM f GROUP BY 1""")
def asset_load_outcome(t):
    """Bulk load of assets: stored ids, repeats in the batch, unknown areas and bad places rejected."""
    k = c("c_custkey")
    one = t.customer.select(k.alias("seq"), (k * 3 % 4000).alias("n"), F.when(k % 50 == 0, "aoi-none").alias("bad_area"),
                            F.when(k % 11 == 0, 200.0).otherwise(-121.0).alias("lon"))
    two = t.customer.where(k % 2 == 0).select((k + 1000000).alias("seq"), (k * 6 % 4000).alias("n"), F.lit(None).cast("string").alias("bad_area"), F.lit(-121.0).alias("lon"))
    batch = one.unionByName(two).select(
        "seq", F.concat(F.lit("asset-"), "n").alias("asset_id"), F.coalesce("bad_area", F.concat(F.lit("aoi-"), c("n") % 5)).alias("aoi_id"),
        F.lit(None).cast("string").alias("source_dataset"), G.point(c("lon"), F.lit(39.7)).alias("geometry"))
    return loads.outcome(*loads.load_assets(batch, t.assets, t.aois, "seq", F.lit("request")))


# --- state -------------------------------------------------------------------

def run_log(t):
    return t.events.select(
        F.concat(F.lit("run-"), c("user_id") % 50).alias("run_id"), c("ts").alias("at"), c("event_id").alias("seq"),
        (c("event_id") * 5 % 7).cast("int").alias("status"),
        F.when(c("event_id") % 3 == 0, F.concat(F.lit("scene-"), "event_id")).when(c("event_id") % 3 == 1, "").alias("before_scene_id"),
        F.create_map(F.concat(F.lit("k"), c("event_id") % 4), F.col("event_type")).alias("metadata"))


LOG = """lg AS (SELECT concat('run-', user_id % 50) AS run_id, ts AS tick, event_id AS seq, CAST(event_id * 5 % 7 AS INT) AS status,
 CASE WHEN event_id % 3 = 0 THEN concat('scene-', event_id) WHEN event_id % 3 = 1 THEN '' END AS before_scene_id, concat('k', event_id % 4) AS mk, event_type AS mv FROM events)"""


@query("", f"""WITH {LOG}, w AS (SELECT *, coalesce(lag(status) OVER (PARTITION BY run_id ORDER BY tick, seq), 0) AS was FROM lg)
SELECT run_id, arg_max(status, (tick, seq)) AS status, min(tick) FILTER (status = 1 AND was <> 1) AS started_at, max(tick) FILTER (status IN (5, 6) AND was <> status) AS completed_at,
arg_max(before_scene_id, (tick, seq)) FILTER (before_scene_id <> '') AS before_scene_id FROM w GROUP BY run_id""")
def run_states(t):
    """Current state of runs folded from their status log."""
    return state.run_state(run_log(t), ["at", "seq"], F.date_trunc("day", c("at")))


@query("", f"""WITH {LOG}, n AS (SELECT run_id, mk, arg_max(mv, (tick, seq)) AS mv FROM lg GROUP BY run_id, mk)
SELECT run_id, string_agg(concat(mk, '=', mv), ',' ORDER BY mk) AS metadata FROM n GROUP BY run_id""")
def run_metadata(t):
    """Metadata of runs merged from their log, newer keys over older ones."""
    m = state.merge_metadata(run_log(t), ["run_id"], ["at", "seq"])
    pairs = F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return m.select("run_id", F.array_join(pairs, ",").alias("metadata"))


ACT = """act AS (SELECT concat(l_orderkey, '-', l_partkey, '-', l_suppkey, '-', l_linenumber) AS risk_event_id, l_shipdate + INTERVAL 1 DAY AS tick,
 concat('u', l_quantity::INT % 7) AS actor, CASE WHEN l_linenumber = 2 THEN 'seen' ELSE '' END AS note, l_linenumber AS seq FROM lineitem WHERE l_suppkey % 3 = 0
 UNION ALL SELECT concat(l_orderkey, '-', l_partkey, '-', l_suppkey, '-', l_linenumber), l_shipdate + INTERVAL 2 DAY, 'late', 'again', 99 FROM lineitem WHERE l_suppkey % 6 = 0
 UNION ALL SELECT concat('none-', o_orderkey), o_orderdate, 'x', '', 1 FROM orders WHERE o_orderkey % 100 = 0)"""


def action_log(t):
    li = t.lineitem.withColumn("risk_event_id", F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    plus = lambda d: (c("l_shipdate") + F.expr(f"INTERVAL {d} DAY")).alias("at")
    one = li.where("l_suppkey % 3 = 0").select("risk_event_id", plus(1), F.concat(F.lit("u"), c("l_quantity").cast("int") % 7).alias("actor"),
                                               F.when(c("l_linenumber") == 2, "seen").otherwise("").alias("note"), c("l_linenumber").alias("seq"))
    two = li.where("l_suppkey % 6 = 0").select("risk_event_id", plus(2), F.lit("late").alias("actor"), F.lit("again").alias("note"), F.lit(99).alias("seq"))
    none = t.orders.where("o_orderkey % 100 = 0").select(F.concat(F.lit("none-"), "o_orderkey").alias("risk_event_id"), c("o_orderdate").alias("at"),
                                                         F.lit("x").alias("actor"), F.lit("").alias("note"), F.lit(1).alias("seq"))
    return one.unionByName(two).unionByName(none)


def open_events(t):
    return t.stored_events.select("risk_event_id", c("acknowledged_at"), F.lit(None).cast("string").alias("acknowledged_by"),
                                  c("dismissed_at"), F.lit(None).cast("string").alias("dismissed_by"),
                                  F.lit(None).cast("map<string,string>").alias("notes"))


for _kind, _key in (("acknowledged", "acknowledgmentNotes"), ("dismissed", "dismissalReason")):
    def _make(kind, key):
        def updated(t):
            up, _ = state.apply_once(open_events(t), action_log(t), kind, key, ["at", "seq"])
            return up.select("risk_event_id", f"{kind}_at", f"{kind}_by", c("notes")[key].alias("note"))

        def rejected(t):
            _, bad = state.apply_once(open_events(t), action_log(t), kind, key, ["at", "seq"])
            return bad.groupBy("error").agg(F.count("*").alias("rows"))

        updated.__name__, rejected.__name__ = f"events_{kind}", f"actions_rejected_{kind}"
        updated.__doc__ = f"Events after the log: the first action makes an event {kind}."
        rejected.__doc__ = "Actions that came too late or name no event, by error."
        return updated, rejected

    _up, _bad = _make(_kind, _key)
    query("stored_events", f"""WITH {ACT}, fa AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY risk_event_id ORDER BY tick, seq) AS k FROM act) WHERE k = 1)
SELECT e.risk_event_id, coalesce(e.{_kind}_at, fa.tick) AS {_kind}_at, CASE WHEN e.{_kind}_at IS NULL THEN fa.actor END AS {_kind}_by,
CASE WHEN e.{_kind}_at IS NULL AND fa.note <> '' THEN fa.note END AS note FROM stored_events e LEFT JOIN fa ON e.risk_event_id = fa.risk_event_id""")(_up)
    query("stored_events", f"""WITH {ACT}, o AS (SELECT act.*, row_number() OVER (PARTITION BY act.risk_event_id ORDER BY tick, seq) AS k, e.risk_event_id IS NULL AS missing, e.{_kind}_at IS NOT NULL AS done
FROM act LEFT JOIN stored_events e ON act.risk_event_id = e.risk_event_id)
SELECT CASE WHEN missing THEN 'not found' ELSE 'already {_kind}' END AS error, count(*) AS rows FROM o WHERE missing OR done OR k > 1 GROUP BY 1""")(_bad)


REQ = """rq AS (SELECT concat('aoi-', n_nationkey % 6) AS aoi_id, n_nationkey AS seq, CASE n_nationkey % 4 WHEN 0 THEN '0 0 * * *' WHEN 1 THEN '' END AS processing_schedule,
 CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey % 2 = 0 END AS processing_enabled, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey * 20 END AS default_lookback_days,
 CASE WHEN n_nationkey % 5 = 0 THEN CAST(n_nationkey * 6 AS DOUBLE) END AS max_cloud_cover FROM nation)"""
REQ_ERR = """CASE WHEN aoi_id = 'aoi-5' THEN 'not found' WHEN max_cloud_cover NOT BETWEEN 1 AND 100 THEN 'MaxCloudCover must be between 1 and 100'
 WHEN default_lookback_days NOT BETWEEN 1 AND 365 THEN 'DefaultLookbackDays must be between 1 and 365' END"""


def schedule_requests(t):
    n = c("n_nationkey")
    return t.nation.select(
        F.concat(F.lit("aoi-"), n % 6).alias("aoi_id"), n.alias("seq"),
        F.when(n % 4 == 0, "0 0 * * *").when(n % 4 == 1, "").alias("processing_schedule"),
        F.when(n % 3 == 0, n % 2 == 0).alias("processing_enabled"), F.when(n % 2 == 0, n * 20).alias("default_lookback_days"),
        F.when(n % 5 == 0, (n * 6).cast("double")).alias("max_cloud_cover"))


@query("aois", f"""WITH {REQ}, ok AS (SELECT * FROM rq WHERE {REQ_ERR} IS NULL), l AS (SELECT aoi_id, arg_max(processing_schedule, seq) AS s, arg_max(processing_enabled, seq) AS e,
arg_max(default_lookback_days, seq) AS d, arg_max(max_cloud_cover, seq) AS m FROM ok GROUP BY aoi_id)
SELECT a.aoi_id, nullif(coalesce(l.s, a.processing_schedule), '') AS processing_schedule, coalesce(l.e, a.processing_enabled) AS processing_enabled,
coalesce(l.d, a.default_lookback_days) AS default_lookback_days, coalesce(l.m, a.max_cloud_cover) AS max_cloud_cover FROM aois a LEFT JOIN l ON a.aoi_id = l.aoi_id""")
def schedules_updated(t):
    """Areas after schedule requests, field by field."""
    out, _ = state.update_schedules(t.aois, schedule_requests(t), ["seq"])
    return out.select("aoi_id", "processing_schedule", "processing_enabled", "default_lookback_days", "max_cloud_cover")


@query("aois", f"""WITH {REQ}, x AS (SELECT {REQ_ERR} AS error FROM rq) SELECT error, count(*) AS rows FROM x WHERE error IS NOT NULL GROUP BY error""")
def schedules_rejected(t):
    _, bad = state.update_schedules(t.aois, schedule_requests(t), ["seq"])
    return bad.groupBy("error").agg(F.count("*").alias("rows"))


@query("stored_events stored_changes stored_runs", """SELECT 'runs' AS table_name, count(*) AS rows FROM stored_runs WHERE status <> 6 UNION ALL
SELECT 'changes', count(*) FROM stored_changes WHERE run_id NOT IN (SELECT run_id FROM stored_runs WHERE status = 6) UNION ALL
SELECT 'risk_events', count(*) FROM stored_events WHERE change_id NOT IN (SELECT change_id FROM stored_changes WHERE run_id IN (SELECT run_id FROM stored_runs WHERE status = 6))""")
def tables_after_run_delete(t):
    """Rows that remain when failed runs are deleted with their changes and events."""
    left = state.delete_runs(t.stored_runs, t.stored_changes, t.stored_events, t.stored_runs.where(c("status") == 6))
    out = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n, df in left.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("assets", """SELECT count(*) FILTER (aoi_id = 'aoi-2' AND asset_type = 3) AS deleted, count(*) FILTER (NOT (aoi_id = 'aoi-2' AND asset_type = 3)) AS kept FROM assets""")
def assets_deleted(t):
    left, gone = state.delete_assets(t.assets, "aoi-2", 3)
    return gone.crossJoin(left.agg(F.count("*").alias("kept")))


@query("stored_changes", """SELECT CASE code WHEN 5 THEN 3 WHEN 10 THEN 3 WHEN 7 THEN 4 WHEN 12 THEN 4 WHEN 8 THEN 5 WHEN 14 THEN 5 WHEN 6 THEN 6 WHEN 11 THEN 6
WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 ELSE 0 END AS change_type, count(*) AS rows FROM (SELECT CAST(o_orderkey % 16 AS INT) AS code FROM orders) GROUP BY 1""")
def change_codes_remapped(t):
    """Old change codes brought to the present ones."""
    from landwatch.functions.change import remap_change_code
    return t.orders.groupBy(remap_change_code((c("o_orderkey") % 16).cast("int")).alias("change_type")).agg(F.count("*").alias("rows"))
