"""The thin opN_ queries: each applies its operator to its whole table and derives the digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, lm, minhash, oracles, packing, pii, quality, substring, topk, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.find(_table(spark, sf_dir, "documents"), "text", carry=["doc_id"]))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(_table(spark, sf_dir, "documents"), "doc_id", "text", keep_text=False)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_table(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), "doc_id", "text", "quality")
    return scored.select("doc_id", "held_out", "score", "predicted")


def op4_ivfpq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, "vec_id", "embedding")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return bpe.encode_table(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_dedup(_table(spark, sf_dir, "documents"), "doc_id", "text").drop("text_hash")


def op7_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, "vec_id", "embedding")


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_table(_table(spark, sf_dir, "documents"), "doc_id", "text")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return packing.pack(docs, "doc_id", "text", "source", public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_table(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), "doc_id", "text", "toxic")
    spans = F.transform("offending", lambda x: F.concat_ws(":", x["start"], x["stop"]))
    return scored.select("doc_id", "held_out", "score", "predicted", F.array_join(spans, ",").alias("offending"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_substring_dedup, op3_quality, op4_ivfpq, op5_byte_bpe, op6_minhash, op7_mtree_topk, op8_kneser_ney, op9_packing, op10_toxicity)}

#: The others rest on learned scores or tokenizers; tests/llm holds each against brute force.
ORACLE_SQL: dict[str, str] = {"op2_substring_dedup": oracles.OP2, "op6_minhash": oracles.OP6, "op7_mtree_topk": oracles.OP7}
