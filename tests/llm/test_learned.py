"""Language and quality: held-out rows, and rows that teach nothing."""

import duckdb
import pyspark.sql.functions as F

from landwatch.llm import language, quality, queries

SF = "/root/testdata/sf0.01"


def test_language_of_held_out_rows(spark):
    queries.op9_language(spark, SF).createOrReplaceTempView("p")
    queries.table(spark, SF, "documents").createOrReplaceTempView("d")
    n, right = spark.sql("select count(*), avg(if(lang_pred = lang, 1, 0)) from p join d using (doc_id) where held_out").first()
    assert n > 200 and right > 0.98


def test_language_without_letters_and_without_labels(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, None, "en"), (4, "123 !!", "en"), (5, "und die", None), (6, "", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify(df, F.lit(True)).collect()}
    assert {i: got[i].lang_pred for i in got} == {1: "en", 2: "de", 3: "und", 4: "und", 5: "de", 6: "und"}
    assert all(0 <= r.score <= 1 for r in got.values()) and got[3].score == 0
    assert {r.lang_pred for r in language.identify(df, F.lit(False)).collect()} == {"und"}
    assert language.identify(df.limit(0), F.lit(True)).collect() == []


def test_quality_of_held_out_rows(spark):
    rows = queries.op8_quality(spark, SF).collect()
    label = dict(duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet' where quality is not null").fetchall())
    held = [(r.score, label[r.doc_id]) for r in rows if r.held_out and r.doc_id in label]
    good, poor = [s for s, y in held if y], [s for s, y in held if not y]
    assert len(rows) == 1000 and len(poor) > 5
    assert sum(a > b for a in good for b in poor) / (len(good) * len(poor)) > 0.95
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, "fine words stand here"), (2, None), (3, ""), (4, "### ### ###"), (4, "### ### ###")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (4, 0), (2, None)], "doc_id long, quality int")
    got = quality.rate(docs, labels, F.lit(True)).collect()
    score = {r.doc_id: r.score for r in got}
    assert len(got) == 5 and score[1] > score[4] and score[2] == score[3]
    assert {r.score for r in quality.rate(docs, labels, F.lit(False)).collect()} == {0.5}
    assert quality.rate(docs.limit(0), labels, F.lit(True)).collect() == []


def test_samples_are_bounded_by_rows(spark):
    rows = [(7, f"fine words {i % 50}", "en") for i in range(400)] + [(i, "andere Worte", "de") for i in range(8, 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(7, 20)], "doc_id long, quality int")
    picked = quality.learned(docs, labels, F.lit(True), "doc_id", "text", "quality", 13)
    assert picked.count() == 13
    found = language.learned(docs, F.lit(True), "doc_id", "text", "lang", 10)
    assert {r["_lang"]: r["count"] for r in found.groupBy("_lang").count().collect()} == {"en": 10, "de": 10}
    for rows in (picked, found):  # the scan and the join are written before rows come together
        assert "Join" not in rows._jdf.queryExecution().toString()
