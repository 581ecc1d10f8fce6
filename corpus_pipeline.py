"""A corpus from raw documents to token ids, in five stages; each works on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, jaccard, mixing, quality, secrets
from ledgerloom.llm.common import scratch, table, unused
from ledgerloom.llm.queries import vocabulary


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good; it learns from the table's labels of documents still there."""
    own = unused(docs, "__good")
    good = quality.classify(docs, table(spark, sf_dir, "labels")).where("predicted = 1").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(good, F.col("doc_id").eqNullSafe(F.col(own)), "left_semi")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class that shingles link at 0.8 or more."""
    return jaccard.keep_one(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.emit(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document (with its number and digests), and the text that they decode to."""
    return bpe.encode_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality classifier", drop_low_quality), ("n-gram Jaccard join", drop_near_copies), ("secret scans", hide_secrets), ("mixing sources", mix_sources), ("BPE encoding", encode)]

#: SQL can express neither the classifier nor the encoder; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = scratch(spark, f"stage{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
