import json
import random

import pytest

from landwatch.sources import geojson as J
from landwatch.sources.split_json import array_elements


def tricky(rnd, n):
    """Features with braces, quotes and escapes in texts, nested arrays and objects, and members around the array."""
    word = lambda: "".join(rnd.choice('ab{}[]",:\\ é\n') for _ in range(rnd.randrange(12)))
    feature = lambda i: {"type": "Feature", "id": f"f{i}", "properties": {"a": word(), word() + "k": word(), "deep": {"x": [{"y": word()}, [1, [2]]]}},
                         "geometry": {"type": "LineString", "coordinates": [[rnd.random(), rnd.random()] for _ in range(rnd.randrange(2, 9))]}}
    return [feature(i) for i in range(n)]


@pytest.fixture
def small_blocks(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda size: spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("size", [61, 700])
def test_elements_equal_the_parsed_file_at_any_block_size(spark, tmp_path, small_blocks, size):
    rnd = random.Random(size)
    docs = {"a": {"type": "x}", "features}": [{"no": 1}], "boxes": [[1, 2], [3, [4]]], "links": [{"features": [{"no": 2}]}],
                  "features": tricky(rnd, size // 30), "crs": {"properties": {"features": [{"no": 3}]}}, "more": [{"no": 4}] * 5},
            "b": {"features": tricky(rnd, 2)}, "c": {"features": []}, "d": {"other": [{"features": [{"no": 5}]}]}}
    for i, (name, doc) in enumerate(docs.items()):
        text = json.dumps(doc, indent=2 if i % 2 else None, ensure_ascii=i % 2 == 0)
        (tmp_path / f"{name}.json").write_text(text + "\n" * (i % 2), encoding="utf-8")
    (tmp_path / "e.json").write_text("")
    (tmp_path / "f.json").write_text('{"features": [{"a": 1}, {"b": 2')
    small_blocks(size)
    rows = array_elements(spark, str(tmp_path), "features").collect()
    got = {n: [json.loads(r.text) for r in sorted(rows, key=lambda r: r.seq) if r.file.endswith(f"/{n}.json")] for n in "abcdef"}
    assert got == {**{n: d.get("features", []) for n, d in docs.items()}, "e": [], "f": []}
    assert sorted(r.seq for r in rows if r.file.endswith("/a.json")) == list(range(size // 30))


def test_one_file_is_read_by_many_tasks(spark, tmp_path, small_blocks):
    features = tricky(random.Random(1), 60)
    path = tmp_path / "one.json"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    small_blocks(2000)
    assert spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() > 10
    rows = {r.feature_id: (r.seq, r.properties["a"], len(r.geometry.parts[0][0])) for r in J.read_collection(spark, str(path)).collect()}
    assert rows == {f["id"]: (i, f["properties"]["a"], len(f["geometry"]["coordinates"])) for i, f in enumerate(features)}
