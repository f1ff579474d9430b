import datetime as dt
import random

from pyspark.sql import functions as F

from landwatch.operators.state import run_state
from landwatch.streaming import jobs
from landwatch.streaming.run_fold import completed, needed

T0 = dt.datetime(2024, 6, 1)
SCHEMA = "run_id string, at timestamp, seq bigint, status int, before_scene_id string"


def test_needed_steps_give_the_same_completion_in_any_order_and_cut():
    rnd = random.Random(4)
    for _ in range(400):
        log = [(rnd.randrange(30), i, rnd.choice([None, 0, 1, 3, 5, 5, 6])) for i in range(rnd.randrange(1, 14))]
        in_order = sorted(log, key=lambda s: s[:2])
        rnd.shuffle(log)
        kept, left = [], log
        while left:
            n = rnd.randrange(1, 5)
            kept, left = needed(kept + needed(left[:n])), left[n:]
        assert completed(kept) == completed(in_order) and kept[-1] == in_order[-1]
    assert len(needed([(i, 0, (1, 3, 5)[i % 3]) for i in range(999)])) == 2


def test_shuffled_stream_equals_the_batch_fold(spark, tmp_path):
    rnd = random.Random(9)
    rows = [("hot" if i % 3 else f"r{i % 5}", T0 + dt.timedelta(hours=i), i, rnd.choice([0, 1, 3, 5, 5, 6]), rnd.choice(["", None, f"s{i}"])) for i in range(90)]
    rows += [(None, T0, 1, 1, "x"), ("open", T0, 1, None, None), ("hot", T0, 0, 5, "late")]
    late = rows[:]
    rnd.shuffle(late)
    for k in range(3):
        spark.createDataFrame(late[k::3], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    jobs.run_state_job(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    got = jobs.newest_state(spark.read.parquet(str(tmp_path / "out" / "state")))
    want = run_state(spark.createDataFrame(rows, SCHEMA), ["at", "seq"], F.date_trunc("day", F.col("at")))
    plain = lambda df: sorted(map(str, df.select("run_id", "status", "started_at", "completed_at", "before_scene_id").collect()))
    assert plain(got) == plain(want)
