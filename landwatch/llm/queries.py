"""The operators applied to the given tables: ``opN_<name>``, and their DuckDB text where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landwatch.llm import alignment, bpe, disclosure, divergence, language, mixture, neighbours, parsing, quality, repeats, shingle_join, simhash, transducer
from landwatch.llm.batches import small_batches

QUERIES, ORACLES = {}, {}
c = F.col


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{folder}/{name}.parquet")


@query
def op1_shingle_join(spark: SparkSession, folder: str) -> DataFrame:
    return shingle_join.components(table(spark, folder, "documents"))


@query
def op2_disclosure(spark: SparkSession, folder: str) -> DataFrame:
    found = disclosure.spans(table(spark, folder, "documents"))
    kinds = F.array(*(F.lit(k) for k in (*disclosure.KINDS, "generalised", "removed")))

    def line(spans):
        placed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], F.array_position(kinds, s["kind"]), s["kind"], s["end"])))
        return F.concat_ws(",", F.transform(placed, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))

    def number(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(number, disclosure.KINDS), F.sha2(line(c("base")).cast("binary"), 256).alias("base_sha256"),
                        line(F.concat("base", "terms")).alias("spans"))


@query
def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = transducer.count(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", c("n_tokens") > 4096)


@query
def op4_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.search(table(spark, folder, "embeddings"), c("vec_id") % 20 == 0)


@query
def op5_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.mix(table(spark, folder, "documents"))


@query
def op6_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return parsing.compare_with_next(table(spark, folder, "documents"))


@query
def op7_repeats(spark: SparkSession, folder: str) -> DataFrame:
    left = repeats.strip(table(spark, folder, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def remainder(ident: str, of: int):
    """crc32 of the id as text, modulo ``of``; -1 for a null id."""
    return F.coalesce(F.crc32(c(ident).cast("string").cast("binary")) % of, F.lit(-1))


@query
def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    rated = quality.rate(table(spark, folder, "documents"), table(spark, folder, "labels"), remainder("doc_id", 5) != 0)
    return rated.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (c("score") >= 0.3).cast("int").alias("predicted"))


@query
def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    found = language.identify(table(spark, folder, "documents"), remainder("doc_id", 3) != 1)
    return found.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


@query
def op10_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = bpe.encode(table(spark, folder, "documents"), vocabulary, public_tokenizers.PATTERN)
    return bpe.decode(ids, vocabulary).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", c("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op11_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))


ORACLES["op11_divergence"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row_no, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
occurring AS (SELECT row_no, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term FROM occurring GROUP BY lang, term HAVING count(DISTINCT row_no) >= 10),
sizes AS (SELECT d.lang, (SELECT count(*) FROM kept k WHERE k.lang = d.lang)::HUGEINT AS v FROM (SELECT DISTINCT lang FROM docs) d),
counts AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM occurring JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (
  SELECT g.lang, g.source, v, coalesce((SELECT sum(n) FROM counts x WHERE x.lang = g.lang AND x.source = g.source), 0)::HUGEINT AS total
  FROM (SELECT DISTINCT lang, source FROM docs) g JOIN sizes USING (lang)),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(x.n, 0) AS n, 1 + (1000000000 * (coalesce(x.n, 0) + 2)) // (total + 2 * v) AS p
  FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN counts x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term),
whole AS (
  SELECT k.lang, k.term, 1 + (1000000000 * ((SELECT sum(n) FROM counts x WHERE x.lang = k.lang AND x.term = k.term) + 2)) // (t.total + 2 * t.v) AS q
  FROM kept k JOIN (SELECT lang, sum(total) AS total, max(v) AS v FROM groups GROUP BY lang) t ON t.lang = k.lang),
apart AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(apart.value, 0)::BIGINT AS value
  FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN apart ON apart.lang = g.lang AND apart.source = g.source AND apart.item = h.source),
words AS (
  SELECT s.lang, s.source, 'term' AS part, s.term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value
  FROM shares s JOIN whole w ON w.lang = s.lang AND w.term = s.term WHERE s.n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM words))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


@query
def op12_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.components(table(spark, folder, "documents"))


@query
def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
