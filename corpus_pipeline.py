"""From raw documents to packed training sequences: quality, toxicity, near-duplicates, packing.

Each stage works on all rows that the one before it kept. The first three return the columns of documents, so any of them
can be left out; the last returns the pieces of sequences.

Defined results: a null or empty text is scored by the bias of either classifier, is like no other text, and is packed as the
end token alone if both keep it; texts of any length are scored, compared and packed whole. A row without doc_id is scored,
compared and packed like any other; it is never learnt from, and of its group of near-duplicates it stays only if no row of
the group has a doc_id. Rows equal in doc_id and text count once from near_duplicates on; of different texts under one
doc_id, all stay or go together. Ties in size or score change nothing: a score at a threshold passes quality and fails
toxicity. Extra columns pass through the first three stages, whatever their names. An empty table passes through all."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oscilla.llm import minhash, packing, quality, toxicity
from oscilla.llm.common import read, scratch_name, shared_table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. It learns from the labelled rows among them, outside the held-out fold."""
    score = scratch_name(docs, "score")
    scored = quality.score(docs, quality.train(docs, read(spark, sf_dir, "labels")), name=score)
    return scored.where(F.col(score) >= quality.THRESHOLD).select(*docs.columns)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    score = scratch_name(docs, "score")
    scored = toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")), name=score)
    return scored.where(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def numbered(docs: DataFrame, number: str) -> DataFrame:
    """docs with a number that is the doc_id where there is one, and else a new one beyond all doc_ids; written once, so that it stays as it is."""
    if docs.where("doc_id is null").isEmpty():
        return docs.withColumn(number, F.col("doc_id").cast("long"))
    ends = docs.agg(F.coalesce(F.min("doc_id"), F.lit(0)).cast("long").alias("low"), F.coalesce(F.max("doc_id"), F.lit(0)).cast("long").alias("high")).first()
    own = F.monotonically_increasing_id() + 1
    fresh = own + F.lit(ends["high"]) if ends["high"] < 1 << 62 else F.lit(ends["low"]) - own
    return shared_table(docs.sparkSession, docs.withColumn(number, F.coalesce(F.col("doc_id").cast("long"), fresh)), "numbered")


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest doc_id."""
    number = scratch_name(docs, "number")
    rows = numbered(docs, number)
    kept = minhash.near_duplicates(rows, doc_id=number).where("kept").select(F.col("doc_id").alias(number)).distinct()
    return rows.join(kept, number, "left_semi").dropDuplicates([number, "text"]).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as sequences of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", good_quality), ("toxicity", not_toxic), ("near_duplicates", no_near_copies), ("packing", packed)]

#: Two stages are trained classifiers and one is a tokenizer: SQL can't express them, so tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared_table(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
