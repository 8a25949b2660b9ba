"""The corpus pipeline: toxicity, near-dedup, substring dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents; where a stage
changes a text, a column n_chars follows. A document whose words all go stays, with an empty text.

Null texts stay null up to packing, where they are the end token alone; empty ones likewise. Very long texts are worked on whole,
each by itself. Rows that repeat an id are judged each by its own text; equal rows are near copies, so one stays, and rows without an
id are never taken for copies. Ties go to the smaller id, then to a hash of the text. Extra columns are carried, whatever
their names, up to packing; an empty table passes through as an empty one.
"""

from __future__ import annotations

import public_tokenizers
from brindle.llm import minhash, packing, pii, substring, toxicity
from brindle.llm._scratch import discard, discard_since, mark, materialise, small_batches
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _folded(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """doc_id, text and all other columns in one struct, so that no name of theirs can clash."""
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in rest), F.lit(0).alias("_")).alias("rest")), rest


def _unfolded(rows: DataFrame, docs: DataFrame, rest: list[str], changed: bool) -> DataFrame:
    def column(c: str):
        if c in ("doc_id", "text"):
            return F.col(c)
        if c == "n_chars" and changed:
            return F.when(F.col("text").isNotNull(), F.length("text")).cast(docs.schema[c].dataType).alias(c)
        return F.col("rest").getField(c).alias(c)

    return rows.select(*(column(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows, rest = _folded(docs)
    scored = toxicity.score_table(rows, labels, "doc_id", "text", "toxic", sentences=False, columns=["text", "rest"])
    return _unfolded(scored.where("predicted = 0"), docs, rest, False)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies share 0.8 of their five-word shingles. One row of each group stays, the one of least id (then of least text hash).

    Every row is judged by its own text: rows that share an id but no text are apart, equal rows are one. Rows without an id all stay.
    """
    rows, rest = _folded(docs)
    node = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("th")))
    rows = rows.withColumn("node", node)
    kept = minhash.near_dedup(rows, "node", "text", shingle=5, percent=80).where("kept and node is not null").select("node").distinct()
    one = rows.where("doc_id is not null").join(kept, "node", "left_semi").dropDuplicates(["node"])
    return _unfolded(one.unionByName(rows.where("doc_id is null")), docs, rest, False)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, rest = _folded(docs)
    cut = substring.dedup(rows, "doc_id", "text", columns=["rest"])
    return _unfolded(cut.select("doc_id", F.col("kept_text").alias("text"), "rest"), docs, rest, True)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, rest = _folded(docs)
    return _unfolded(pii.redact(rows, "text"), docs, rest, True)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack(docs, "doc_id", "text", "source", public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", keep_one_of_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]

#: Learned scores and tokenizers are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        since, before = mark(), getattr(docs, "scratch_path", None)
        docs = materialise(stage(spark, docs, sf_dir), name)
        # What the stage wrote on its way, and its input, are read no more.
        discard_since(spark, since, docs.scratch_path)
        if before:
            discard(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
