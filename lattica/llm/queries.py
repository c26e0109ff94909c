"""The queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import bpe, jaccard, licence, packing, pii, quality, spans, suffix, topk, toxicity
from lattica.llm.common import table

BYTE_BPE = "byte_bpe_50k.json"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.search(rows, rows.where("vec_id % 50 = 0"), 5)


OP2_SQL = """
WITH v AS (
    SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op6_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spans.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_sentences").alias("n_sentences"), F.col("_removed").alias("n_removed"), F.length("text").cast("long").alias("n_chars_kept"), F.sha2("text", 256).alias("kept_sha256"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"), pii.train(spark))
    of_kind = lambda k, x: x["kind"] == k
    counts = [F.size(F.filter("_base", partial(of_kind, k))).cast("long").alias(f"n_{k}") for k in pii.BASE]
    more = [F.size(F.filter("_spans", partial(of_kind, k))).cast("long").alias(f"n_{k}") for k in pii.KINDS if k not in pii.BASE]
    every = F.size("_spans").cast("long").alias("n_spans")
    return found.select("doc_id", *counts, F.sha2(pii.listed("_base"), 256).alias("base_sha256"), pii.listed("_spans").alias("spans"), *more, every)


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")


def op9_licence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence.scan(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score = docs.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), toxicity.score(docs, model).alias("score"))
    return score.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_bpe": op1_bpe, "op2_topk": op2_topk, "op3_packing": op3_packing, "op4_suffix": op4_suffix, "op5_quality": op5_quality, "op6_spans": op6_spans, "op7_pii": op7_pii, "op8_jaccard": op8_jaccard, "op9_licence": op9_licence, "op10_toxicity": op10_toxicity}
SQL: dict[str, str] = {"op2_topk": OP2_SQL, "op9_licence": licence.sql()}
