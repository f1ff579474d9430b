"""A training corpus from raw documents: stages that each call one operator of landwatch.llm.

Every stage reads all that its predecessor kept, written as Parquet. All but the last return the
columns of ``documents``. Null, empty and repeated rows: a text without letters goes with the first
stage; of repeated rows the second keeps one. Stages decide by row, not by id: a null id is one like others, rows of
one id are documents of their own.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landwatch.llm import bpe, disclosure, language, mixture, shingle_join
from landwatch.llm.batches import small_batches, unused
from landwatch.session import shared_dir

c = F.col


def with_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key equal for equal rows only, and its name: the order of ids, null last, then of a 128-bit hash of all columns."""
    named = [c(f"`{k}`") for k in docs.columns]
    whole, key = [*named, *(k.isNull() for k in named)], unused(docs, "_row")
    return docs.withColumn(key, F.struct(c("doc_id").isNull().alias("_none"), "doc_id", F.xxhash64(*whole).alias("_h1"), F.xxhash64(F.lit(1), *whole).alias("_h2"))), key


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; a text that is null or has no letters goes."""
    small_batches(spark)
    found = language.identify(docs, F.lit(True), keep=docs.columns)
    return found.where(c("lang_pred") != language.UNKNOWN).select(*docs.columns)


def one_of_a_kind(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by five-word shingles at a likeness of 0.8 or more: that of least id, a null id after all others."""
    small_batches(spark)
    keyed, key = with_key(docs)
    groups = shingle_join.components(keyed, key, words=5, threshold=(4, 5))
    stay = groups.where(c(key) == c("component_id")).select(key).distinct()
    return keyed.join(stay, key, "left_semi").dropDuplicates([key]).select(*docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data and the terms that reveal it replaced."""
    small_batches(spark)
    return disclosure.sanitise(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes; documents that it leaves out go."""
    small_batches(spark)
    keyed, key = with_key(docs)
    times = unused(keyed, "_copies")
    plan = mixture.mix(keyed, ident=key).where("taken > 0").groupBy(key).agg(F.sum(c("taken") / c("size")).cast("int").alias(times))
    rows = keyed.join(plan, key).dropDuplicates([key])
    return rows.select(*docs.columns, F.explode(F.sequence(F.lit(1), c(times))).alias(unused(keyed, "_copy"))).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, and the digest of what they decode to."""
    small_batches(spark)
    vocabulary, keep = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), ("doc_id", "lang", "source", "n_chars")
    ids = bpe.encode(docs, vocabulary, public_tokenizers.PATTERN, keep=keep)
    return bpe.decode(ids, vocabulary, keep=keep).select(*keep, F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("known_language", known_language), ("one_of_a_kind", one_of_a_kind), ("without_personal_data", without_personal_data),
          ("mixed_sources", mixed_sources), ("encoded", encoded)]
#: Kernel training, graph components, corpus statistics, knapsacks and merges are no SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
