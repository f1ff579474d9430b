"""Columns of the input whose names are those that operators use themselves."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from landwatch.llm import disclosure

TEXTS = [(i, f"Mail ann{i % 2}@mail.example now, the ledger of Quillon says so. {i % 3}", "en", "s", 40) for i in range(12)] + [(None, None, None, None, None), (3, "", "en", "s", 0)]


def table(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string, lang string, source string, n_chars int")
    return df.withColumns({k: F.lit(k) for k in ("_hash", "_terms", "_salt", "_row", "_copies", "_copy", "text_hash", "component_id")})


def test_sanitise_keeps_clashing_columns(spark):
    df = table(spark)
    plain = {(r.doc_id, r.text) for r in disclosure.sanitise(df.select("doc_id", "text")).collect()}
    got = disclosure.sanitise(df)
    assert got.columns == df.columns
    rows = got.collect()
    assert {(r.doc_id, r.text) for r in rows} == plain and all(r[k] == k for r in rows for k in ("_hash", "_terms", "_salt", "_row"))


@pytest.mark.parametrize("stage", [corpus_pipeline.one_of_a_kind, corpus_pipeline.mixed_sources])
def test_stages_keep_clashing_columns(spark, stage):
    df = table(spark)
    got = stage(spark, df, "")
    assert got.columns == df.columns
    rows = got.collect()
    assert rows and all(r[k] == k for r in rows for k in ("_row", "_copies", "_copy", "component_id"))
    assert stage(spark, df.where("false"), "").collect() == []
