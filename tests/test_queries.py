import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import TABLES, plain

SF = "/root/testdata/sf0.001"
QUICK = ["change_types", "factor_points", "area_statistics", "run_list", "plan_events_by_level", "imagery_check", "event_load_outcome", "run_states",
         "change_statistics", "change_regions", "slope_and_aspect", "terrain_products", "way_features", "scene_details", "segmentation_metrics"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 140


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    assert cols == sorted(names)
    want = sorted(tuple(plain(r[names.index(k)]) for k in cols) for r in cur.fetchall())
    assert sorted(tuple(plain(r[k]) for k in cols) for r in df.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
